"""Small tables with the awkward rows that every operator has to cope with."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the of and to in is that for with river stone water light house green morning field".split(),
    "fr": "le la les de des et un une que dans rivière pierre lumière maison matin été forêt".split(),
    "de": "der die das und ist von mit den nicht Fluss Stein Wasser Licht Haus Morgen über grün".split(),
}


def prose(draw, lang, n):
    return " ".join(draw.choice(WORDS[lang]) + draw.choice(["", "", "", "s", "en"]) for _ in range(n))


def documents(n=80, seed=3):
    """Prose in three languages, then nulls, empties, a very long text, copies and a repeated row."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        lang = draw.choice(sorted(WORDS))
        rows.append((i, prose(draw, lang, draw.randint(12, 60)), lang, f"s{i % 4}"))
    first = rows[0]
    edited = first[1].split()
    edited[len(edited) // 2] = "elsewhere"
    rows += [
        (n, None, "en", "s0"),
        (n + 1, "", None, None),
        (n + 2, " \n\t ", "fr", None),
        (n + 3, first[1], first[2], "s1"),
        (n + 4, " ".join(edited), first[2], "s2"),
        (n + 5, first[1].upper(), first[2], "s2"),
        (n + 6, prose(draw, "de", 6000), "de", "s3"),
        (n + 7, "### 123 $$$", "en", "s3"),
        (n + 8, "x", "en", "s1"),
        (n + 9, "▁ <|endoftext|> a\x00b 'S 中文 🙂", "en", ""),
        (n + 9, "▁ <|endoftext|> a\x00b 'S 中文 🙂", "en", ""),
        (None, "a row without an id and not much to say", "en", "s1"),
    ]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def clashing(df):
    """The same table with extra columns named like those that operators make for themselves."""
    from pyspark.sql import functions as F

    names = [
        "score", "size", "slot", "shard", "key", "pieces", "n_pieces", "lossless", "copies", "_key", "_doc",
        "_copy", "_words", "n_tokens", "lang_pred", "ambiguous", "spots", "class_id", "bands", "a.b",
    ]
    return df.select(*df.columns, *[F.lit(i).alias(c) for i, c in enumerate(names)])
