"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Encoding merges the best-scored pair of neighbouring pieces again and again. With dropout each
candidate merge is skipped with probability ``dropout``; the coin is a hash of seed, document and
the candidate's place, so a seed gives one segmentation, another seed another, and reruns agree.
Without dropout the result is the library's own. Whatever was skipped, the pieces spell the text.

No piece of the model has a space behind something else, so a text falls apart before its spaces
and around characters that the model lacks; words are then merged many at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from rillspark.llm.merging import PairTable, merged_words
from rillspark.llm.tables import mapped, text_slices

MODEL = "piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 10
SPACE = "▁"
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_PLACE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def model_arrays(path: str | None = None) -> dict:
    """The model as arrays, read on the driver: pairs, characters, byte pieces and spellings."""
    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
    n = model.get_piece_size()
    special = [model.is_control(i) or model.is_unknown(i) for i in range(n)]
    pieces = {
        model.id_to_piece(i): i
        for i in range(n)
        if not (special[i] or model.is_byte(i) or model.is_unused(i))
    }
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("a piece crosses words; this encoder cuts before spaces")
    scores = {model.get_score(i) for p, i in pieces.items() if len(p) > 1}
    order = {s: r for r, s in enumerate(sorted(scores, reverse=True))}
    pairs = [
        (pieces[p[:k]], pieces[p[k:]], order[model.get_score(i)], i)
        for p, i in pieces.items()
        for k in range(1, len(p))
        if p[:k] in pieces and p[k:] in pieces
    ]
    left, right, rank, merged = np.array(pairs, np.int32).T
    single = {ord(p): i for p, i in pieces.items() if len(p) == 1 and p != SPACE}
    bytes_of = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
    spelled = [
        b"" if special[i] else bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
        else model.id_to_piece(i).replace(SPACE, " ").encode()
        for i in range(n)
    ]
    return {
        "pairs": (left, right, rank, merged),
        "points": np.array(list(single), np.int64),
        "ids": np.array(list(single.values()), np.int32),
        "space": pieces[SPACE],
        "bytes": np.array([bytes_of[b] for b in range(256)], np.int32),
        "spelled": spelled,
    }


def _hashed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def spelled_out(ids: list[int], spelled: list[bytes]) -> str:
    """The text that the pieces spell, without the space that encoding put before it."""
    made = b"".join([spelled[i] for i in ids])
    return made.removeprefix(b" ").decode("utf-8", "surrogatepass")


class Encoder:
    def __init__(self, arrays: dict):
        self.table = PairTable(*arrays["pairs"])
        self.of_point = np.full(0x110000, -1, np.int32)
        self.of_point[arrays["points"]] = arrays["ids"]
        # A space becomes the space piece; the mark itself is spelled in bytes, so it comes back.
        self.of_point[32] = arrays["space"]
        self.bytes, self.spelled = arrays["bytes"], arrays["spelled"]

    def encode(self, texts: list[str], keys: np.ndarray, dropout: float) -> pa.ListArray:
        """Ids of each text. ``keys`` holds a 64-bit key per text for the coins."""
        if not any(texts):
            return pa.array([[] for _ in texts], pa.list_(pa.int32()))
        lengths = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts))
        joined = "".join(" " + t for t in texts if t)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(lengths)
        first = (ends - lengths)[lengths > 0]
        symbols = self.of_point[points]
        blank, lone = points == 32, symbols < 0
        begins = blank & ~np.r_[False, blank[:-1]] | lone | np.r_[False, lone[:-1]]
        begins[first] = True
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.r_[starts, len(points)])
        skips = None
        if dropout > 0:
            owner = np.repeat(np.arange(len(texts)), lengths)
            base, limit = (ends - lengths).astype(np.uint64), np.uint64(min(dropout, 1.0) * (2**64 - 2048))

            def skips(start, middle, end):
                text = owner[start]
                at, salt = base[text], keys[text]
                for place, mix in zip((start, middle, end), _PLACE, strict=True):
                    salt = _hashed(salt ^ ((place.astype(np.uint64) - at) * mix))
                return salt <= limit

        out = np.full(len(points), -1, np.int32)
        kept = np.zeros(len(points), bool)
        for at, ids in merged_words(symbols, starts, sizes, self.table, skips):
            out[at], kept[at] = ids, True
        where = np.flatnonzero(kept)
        ids = out[where]
        # Characters that the model lacks: one piece for each of their bytes.
        wide = points[where]
        repeat = np.where(ids >= 0, 1, 1 + (wide >= 0x80) + (wide >= 0x800) + (wide >= 0x10000))
        ids_all = np.repeat(ids, repeat)
        if (ids < 0).any():
            spelled = "".join(map(chr, wide[ids < 0].tolist())).encode("utf-8", "surrogatepass")
            ids_all[ids_all < 0] = self.bytes[np.frombuffer(spelled, np.uint8)]
        upto = np.r_[0, np.cumsum(repeat)]
        offsets = upto[np.searchsorted(where, np.r_[0, ends])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids_all))

    def decode(self, ids: list[int]) -> str:
        return spelled_out(ids, self.spelled)


def encoded(
    docs: DataFrame,
    seed: int = SEED,
    dropout: float = DROPOUT,
    path: str | None = None,
    check: bool = True,
) -> DataFrame:
    """Add pieces (array of ids), n_pieces and, with ``check``, lossless (they decode to the text).

    A null text gives null pieces, null n_pieces and null lossless; an empty one no pieces. The
    coins depend on seed, doc_id and place, not on partitions or neighbours; rows that share a
    doc_id share coins. Existing columns of these names are replaced, all others are kept.
    """
    arrays = model_arrays(path)
    kept: list[Encoder] = []

    def encode(rows: pa.StructArray, batch: pa.RecordBatch) -> list[pa.Array]:
        if not kept:
            kept.append(Encoder(arrays))
        keys = batch["coins"].to_numpy().astype(np.uint64)
        texts = pc.fill_null(rows.field("text"), "")
        pieces, same = [pa.array([], pa.list_(pa.int32()))], []
        for a, b in text_slices(texts, 1_000_000):
            part = texts[a:b].to_pylist()
            pieces.append(kept[0].encode(part, keys[a:b], dropout))
            if check:
                lists = pieces[-1].to_pylist()
                same += [kept[0].decode(p) == t for p, t in zip(lists, part, strict=True)]
        all_of_it = pa.concat_arrays(pieces)
        made = [all_of_it, pc.list_value_length(all_of_it), *([pa.array(same, pa.bool_())] if check else [])]
        there = pc.is_valid(rows.field("text"))
        return [pc.if_else(there, m, pa.scalar(None, m.type)) for m in made]

    added = StructType().add("pieces", ArrayType(IntegerType())).add("n_pieces", IntegerType())
    if check:
        added = added.add("lossless", "boolean")
    return mapped(docs, encode, added, coins=F.xxhash64(F.lit(seed), F.col("doc_id")))


def decoded(pieces: DataFrame, path: str | None = None) -> DataFrame:
    """Add ``decoded``, the text that the column ``pieces`` spells; null for null."""
    spelled = model_arrays(path)["spelled"]

    def decode(rows: pa.StructArray, _) -> list[pa.Array]:
        made = [None if p is None else spelled_out(p, spelled) for p in rows.field("pieces").to_pylist()]
        return [pa.array(made, pa.string())]

    return mapped(pieces, decode, StructType().add("decoded", "string"))
