"""Document fingerprints from spots: chains of content words that follow a common word.

A common word (an anchor) and the next ``CHAIN`` content words, found before ``REACH`` further
anchors have passed, make one spot. The set of a text's spots is its fingerprint: it follows the
prose and not headers or menus, which have few common words. Two fingerprints are compared by
Jaccard; the lengths alone bound it from above, so most pairs need no look at the sets.

All of it is DataFrame expressions. A text without a spot is represented by its words, one
without words by its characters, so that equal texts always agree and different kinds never do.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.session import durable

# Common words of four languages. Fixed values of this operator; callers may pass others.
ANCHORS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "be", "by",
    "on", "this", "are", "from", "or", "an", "a",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "que", "qui", "dans", "pour", "par",
    "sur", "est", "en", "au",
    "der", "die", "das", "und", "ist", "von", "mit", "den", "dem", "zu", "nicht", "ein", "eine",
    "auf", "sich", "als",
    "el", "los", "las", "del", "y", "se", "con", "una", "por", "para", "es",
)
CHAIN = 2
REACH = 4
RANGES = 128
MOST_CHUNKS = RANGES * RANGES
CHUNK_ROWS = 500


def spots(
    text: Column, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN, reach: int = REACH
) -> Column:
    """The sorted distinct spot hashes (8 hex digits of md5) of a text; null counts as empty."""
    pattern = " (" + "|".join(anchors) + ")(?= )"

    def digest(word: Column) -> Column:
        return F.substring(F.md5(word), 1, 8)

    def of_parts(text: Column, plain: Column, parts: Column) -> Column:
        def behind(p: Column) -> Column:
            return F.substring_index(F.trim(F.split_part(p, F.lit("\u0002"), F.lit(2))), " ", chain)

        def spot(short: Column):
            def of(p: Column, i: Column) -> Column:
                following = F.array_remove(F.slice(short, i + 1, reach), "")
                words = F.substring_index(F.array_join(following, " "), " ", chain)
                anchor = F.split_part(p, F.lit("\u0002"), F.lit(1))
                return F.when((i > 0) & (words != ""), digest(F.concat(anchor, F.lit(":"), words)))

            return of

        found = _let(
            F.transform(parts, behind),
            lambda short: F.array_distinct(F.array_compact(F.transform(parts, spot(short)))),
        )
        words = F.transform(F.split(plain, " "), lambda w: digest(F.concat(F.lit("w:"), w)))
        instead = F.when(plain != "", F.array_distinct(words)).otherwise(
            F.array(digest(F.concat(F.lit("="), text)))
        )
        return _let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(instead))

    def of_plain(text: Column, plain: Column) -> Column:
        marked = F.regexp_replace(
            F.concat(F.lit(" "), plain, F.lit(" ")), pattern, "\u0001$1\u0002"
        )
        return _let(F.split(marked, "\u0001"), lambda parts: of_parts(text, plain, parts))

    def of_text(text: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
        return _let(plain, lambda p: of_plain(text, p))

    return F.sort_array(_let(F.coalesce(text, F.lit("")), of_text))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard of two spot sets; 0 where the lengths alone put it below ``at_least``."""
    short, long = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    exact = shared / (F.size(a) + F.size(b) - shared)
    return F.when((long == 0) | (short < long * at_least), 0.0).otherwise(exact)


def near_pairs(prints: DataFrame, key: str, sets: str, at_least: float = 0.8) -> DataFrame:
    """Pairs of different fingerprints with Jaccard of at least ``at_least``.

    Equal fingerprints are one class, named by its smallest key: returns class_a < class_b and
    likeness; ``classes`` gives the membership. A pair must share one of the rarest spots of each
    set (as many as ``at_least`` leaves room for), and its lengths lie in the same band or in
    neighbouring bands; the join is on spot and band, which spreads a frequent spot over bands.
    """
    each = classes(prints, key, sets).select(F.col("class"), F.col(sets)).distinct()
    each = durable(each)
    rare = each.select(F.explode(sets).alias("spot")).groupBy("spot").agg(F.count(F.lit(1)).alias("n"))
    ranked = (
        each.select("class", F.explode(sets).alias("spot"), F.size(sets).alias("size"))
        .join(rare, "spot")
        .withColumn(
            "at", F.row_number().over(Window.partitionBy("class").orderBy("n", "spot"))
        )
        .filter(F.col("at") <= F.col("size") - F.ceil(F.col("size") * at_least) + 1)
    )
    band = F.floor(F.log("size") / -math.log(at_least)).cast("int")
    left = ranked.select("spot", band.alias("band"), F.col("class").alias("class_a"), F.col("size").alias("size_a"))
    right = ranked.select(
        "spot",
        F.explode(F.array(band - 1, band, band + 1)).alias("band"),
        F.col("class").alias("class_b"),
        F.col("size").alias("size_b"),
    )
    longer, shorter = F.greatest("size_a", "size_b"), F.least("size_a", "size_b")
    found = (
        left.join(right, ["spot", "band"])
        .filter((F.col("class_a") < F.col("class_b")) & (shorter >= longer * at_least))
        .select("class_a", "class_b")
        .distinct()
    )
    sets_of = lambda side: each.select(F.col("class").alias(f"class_{side}"), F.col(sets).alias(f"_{side}"))
    return (
        found.join(sets_of("a"), "class_a")
        .join(sets_of("b"), "class_b")
        .withColumn("likeness", likeness(F.col("_a"), F.col("_b"), at_least))
        .filter(F.col("likeness") >= at_least)
        .select("class_a", "class_b", "likeness")
    )


def classes(prints: DataFrame, key: str, sets: str) -> DataFrame:
    """Key, set and the class of equal fingerprints: the smallest key among them."""
    smallest = prints.groupBy(F.col(sets).alias("_set")).agg(F.min(key).alias("class"))
    return prints.join(smallest, F.col(sets) == F.col("_set")).select(key, sets, "class")


def _range_of(number: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most ``number``; a balanced tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(number < bounds[middle], tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(bounds))


def chunk_of(docs: DataFrame, number: str = "doc_id") -> Column:
    """A chunk per row that rises with ``number``, of about ``CHUNK_ROWS`` rows.

    Quantiles give up to ``RANGES`` ranges with like numbers of rows, and each is cut evenly by
    value. There are at most ``MOST_CHUNKS`` chunks; -1 holds the nulls.
    """
    steps = [i / RANGES for i in range(1, RANGES)]
    n, low, high, inner = docs.agg(
        F.count(number), F.min(number), F.max(number), F.percentile_approx(number, steps, 10_000)
    ).first()
    if not n:
        return F.lit(-1)
    bounds = sorted(set(inner) - {low})
    starts, ends = [low, *bounds], [*bounds, high + 1]
    cuts = min(RANGES, max(1, round(n / CHUNK_ROWS / len(starts))))
    value = F.col(number)
    at = _range_of(value, bounds)
    start = F.element_at(F.array(*[F.lit(s) for s in starts]), at + 1)
    width = F.element_at(F.array(*[F.lit(e - s) for s, e in zip(starts, ends, strict=True)]), at + 1)
    inside = F.floor((value - start) / width * cuts)
    return F.when(value.isNull(), -1).otherwise(at * cuts + F.least(inside, F.lit(cuts - 1))).cast("int")


def beside_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and spots of every document beside those of the next by falling doc_id.

    After the smallest doc_id comes the largest again. Equal doc_ids follow each other by crc32
    of the text, a null doc_id comes last, a null text is empty. Texts are shuffled once, by
    chunks of doc_id; the first document of a chunk visits the chunk before as a guest.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.crc32(text).alias("_tie")
    )
    rows = rows.withColumn("_chunk", chunk_of(rows))
    # At most MOST_CHUNKS + 1 rows, whatever the input: small enough for one window and a broadcast.
    order = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), (-F.col("_tie")).alias("tie"))
    heads = rows.groupBy("_chunk").agg(F.max(order).alias("_head"))
    falling = Window.orderBy(F.col("_chunk").desc())
    before = F.coalesce(F.lag("_chunk").over(falling), F.min("_chunk").over(Window.partitionBy()))
    heads = durable(
        heads.select(
            F.col("_head.id").alias("_id"), (-F.col("_head.tie")).alias("_t"), before.alias("_visits")
        )
    )
    own = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    guests = (
        rows.join(F.broadcast(heads), (own == F.col("_id")) & (F.col("_tie") == F.col("_t")))
        .withColumn("_chunk", F.col("_visits"))
        .drop("_id", "_t", "_visits")
    )
    both = rows.withColumn("_guest", F.lit(0)).unionByName(guests.withColumn("_guest", F.lit(1)))
    both = both.withColumn("spots", spots(F.col("text")))
    down = Window.partitionBy("_chunk").orderBy("_guest", F.col("doc_id").desc_nulls_last(), "_tie")
    return (
        both.withColumn("next_text", F.lead("text").over(down))
        .withColumn("next_spots", F.lead("spots").over(down))
        .filter("_guest = 0")
        .select("doc_id", "text", "spots", "next_text", "next_spots")
    )


def edited(text: Column, other: Column) -> Column:
    """The text with its last half (rounded down) replaced by as much of the other's beginning."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(other, half))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness.

    Returns doc_id, n_chars, edited_text, spots, edited_spots, next_spots, near_edited, near_next.
    Rows are kept one for one; an empty table gives none. A single document is its own next.
    Other columns are ignored, whatever their names.
    """
    pairs = beside_next(docs).withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    made = pairs.withColumn("edited_spots", spots(F.col("edited_text")))
    return made.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        "edited_text",
        "spots",
        "edited_spots",
        "next_spots",
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )
