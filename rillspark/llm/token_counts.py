"""Token counts of a byte-level BPE vocabulary by two deterministic transducers.

The first cuts a text into words. Its alphabet is the class of a character (letter, number,
apostrophe that starts a contraction, space or other blank with or without a non-blank behind it,
anything else), so it needs no look-ahead of its own; a transition says whether a word starts here.
A long run of text is cut into chunks that do not know their entry state: a chunk is first run
from all states at once, which gives its state map; the maps are composed by a parallel prefix
scan; only then is the chunk run from the one state it is really entered in.

The second reads the bytes of a word from its start. Its states are the prefixes of the vocabulary's entries,
compiled on the driver; a transition carries the number of tokens that the byte adds to the prefix, which is negative
where it makes several tokens into one. The sum over a word's transitions is its count. Words that it does not accept
are merged by rank, once; a task then compiles them in too, up to ``MOST_STATES``. Words longer than ``LONGEST`` bytes are kept
with their counts, up to ``ROOM_FOR_LONGER``. Past either bound the merges run every time, so memory stays bounded and
counts stay exact.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from rillspark.llm.merging import LONGEST, NOTHING, PairTable, merged_words
from rillspark.llm.tables import mapped, text_slices

VOCABULARY = "byte_bpe_50k.json"
MOST_STATES = 600_000
CHUNK = 512
ROOM_FOR_LONGER = 1 << 23  # bytes of words too long for the transducer, whose counts a task keeps
GROW_AFTER = 4_096  # words that have left the transducer; more as it grows
NO_END = 1 << 20
BIAS = LONGEST  # added to emitted counts, which the table of transitions holds without a sign

# Classes of characters.
BREAK, LETTER, NUMBER, OTHER, SPACE, SPACE_LAST, BLANK, BLANK_LAST, QUOTE2, QUOTE3 = range(10)
# States: what the word read so far is.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, JOINING, SHORT1, SHORT2 = range(8)
STATES, CLASSES = 8, 10


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a word starts, by class and state."""
    after = np.zeros((CLASSES, STATES), np.uint8)
    starts = np.ones((CLASSES, STATES), bool)
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    for c, inside in run.items():
        after[c] = inside
        starts[c, inside] = False
        starts[c, JOINING] = False
    # A blank that ends its run of blanks stands alone, unless it is a space: that one joins.
    after[SPACE] = after[BLANK] = IN_BLANKS
    starts[SPACE, IN_BLANKS] = starts[BLANK, IN_BLANKS] = False
    after[SPACE_LAST] = JOINING
    after[BLANK_LAST] = START
    # An apostrophe starts a contraction only where a word may start; else it is like any other.
    for c, short in ((QUOTE2, SHORT1), (QUOTE3, SHORT2)):
        after[c] = short
        after[c, [IN_OTHERS, JOINING]] = IN_OTHERS
        starts[c, [IN_OTHERS, JOINING]] = False
    after[:, SHORT2] = SHORT1
    after[:, SHORT1] = START
    starts[:, [SHORT1, SHORT2]] = False
    after[BREAK], starts[BREAK] = START, True
    return after, starts


AFTER, STARTS = _machine()


@cache
def kinds_of_points() -> np.ndarray:
    """Class of each code point, look-ahead aside; made on the driver, shipped with the tasks."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    # The white space of Unicode.
    table[[9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    table[0x2000:0x200B] = BLANK
    table[32] = SPACE
    return table


def classes_of(points: np.ndarray, breaks: np.ndarray, kinds_table: np.ndarray) -> np.ndarray:
    """The splitter's alphabet for code points; ``breaks`` marks positions that separate texts."""
    kinds = kinds_table[points]
    kinds[breaks] = BREAK
    ahead = lambda k: np.r_[kinds[k:], np.full(min(k, len(kinds)), BREAK, np.uint8)]
    blank = (kinds == SPACE) | (kinds == BLANK)
    solid_next = np.r_[~blank[1:], False] & (ahead(1) != BREAK)
    made = kinds.copy()
    made[blank & solid_next] += 1  # SPACE to SPACE_LAST, BLANK to BLANK_LAST
    quotes = np.flatnonzero((points == 39) & ~breaks)
    if len(quotes):
        padded = np.r_[np.where(breaks, 0, points), 0, 0]
        first, second = padded[quotes + 1], padded[quotes + 2]
        two = np.isin(first, [ord(c) for c in "stmd"])
        three = (
            ((first == ord("r")) & (second == ord("e")))
            | ((first == ord("v")) & (second == ord("e")))
            | ((first == ord("l")) & (second == ord("l")))
        )
        made[quotes[two]] = QUOTE2
        made[quotes[three]] = QUOTE3
    return made


def scanned(maps: np.ndarray) -> np.ndarray:
    """State in which each chunk is entered, by a parallel prefix scan over state maps [chunk, state]."""
    total, step = maps.copy(), 1
    while step < len(total):
        # The map of the chunks up to here, behind the map of those before them.
        total[step:] = np.take_along_axis(total[step:], total[:-step].astype(np.intp), 1)
        step *= 2
    return np.r_[np.uint8(START), total[:-1, START]] if len(total) else np.zeros(0, np.uint8)


def word_starts(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Whether a word starts at each position."""
    n = len(classes)
    chunks = -(-n // chunk)
    padded = np.full(chunks * chunk, BREAK, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(chunks, chunk).T)
    flat_after, flat_starts = AFTER.ravel(), STARTS.ravel()
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (chunks, 1))
    for column in columns:
        maps = flat_after[(column * np.uint8(STATES))[:, None] + maps]
    state = scanned(maps)
    out = np.empty((chunk, chunks), bool)
    for i, column in enumerate(columns):
        at = column * np.uint8(STATES) + state
        out[i] = flat_starts[at]
        state = flat_after[at]
    return out.T.ravel()[:n]


def laid_out(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words, and where each starts and how long it is."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths, lengths


class Transducer:
    """Counts tokens along the bytes of many words at once.

    ``edges`` has the columns from, byte, to and emitted; state 0 has read nothing. ``emitted`` is summed up to each state in
    ``sums``; ``last`` is what is added where a word ends in the state, ``NO_END`` where none does.
    """

    def __init__(self, edges: np.ndarray, sums: np.ndarray, last: np.ndarray):
        self.edges, self.sums, self.last = edges, sums, last
        start, byte, end, emitted = edges.T
        self.table = PairTable(start, byte, emitted + BIAS, end)

    def run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of what the transitions of each word emit, and whether it is accepted."""
        state, total = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        inside = lengths <= LONGEST
        going = np.flatnonzero(inside)
        for i in range(int(lengths[going].max(initial=0))):
            going = going[lengths[going] > i]
            found = self.table.find(state[going], data[starts[going] + i])
            lost = found == NOTHING
            inside[going[lost]] = False
            going, found = going[~lost], found[~lost]
            state[going] = found & 0xFFFFFFFF
            total[going] += (found >> 38) - BIAS
        last = self.last[state]
        return total + last, inside & (last != NO_END)

    def grown(self, words: list[bytes], counts: np.ndarray, most: int = MOST_STATES) -> Transducer:
        """With these different words too, of which the tokens are known; those without room are left out.

        A transition into the new end of a word makes the sum right; one into another new state emits nothing.
        """
        data, starts, lengths = laid_out(words)
        state, alive = np.zeros(len(words), np.int64), lengths <= LONGEST
        edges, sums, last = [self.edges], self.sums.astype(np.int64), self.last.astype(np.int64)
        for i in range(int(lengths[alive].max(initial=0))):
            going = np.flatnonzero(alive & (lengths > i))
            byte = data[starts[going] + i].astype(np.int64)
            found = self.table.find(state[going], byte)
            state_of = found & 0xFFFFFFFF
            new = np.flatnonzero(found == NOTHING)
            each, number = np.unique(state[going[new]] << 8 | byte[new], return_inverse=True)
            room = max(0, most - len(sums))
            alive[going[new[number >= room]]] = False
            state_of[new] = len(sums) + number
            state[going] = state_of
            start = each[:room] >> 8
            made = sums[start]
            ends = (lengths[going[new]] == i + 1) & (number < room)
            made[number[ends]] = counts[going[new[ends]]]
            edges.append(np.c_[start, each[:room] & 255, len(sums) + np.arange(len(start)), made - sums[start]])
            sums, last = np.r_[sums, made], np.r_[last, np.full(len(start), NO_END)]
        last[state[alive]] = counts[alive] - sums[state[alive]]
        return Transducer(np.concatenate(edges), sums, last)


class Counter:
    """Tokens of words: by the transducer where it has a path, else by the merges."""

    def __init__(self, made: dict, most: int = MOST_STATES):
        self.table = PairTable(made["left"], made["right"], made["rank"], made["merged"])
        self.first, self.kinds, self.most = made["first"], made.get("kinds"), most
        self.machine = Transducer(made["edges"], made["sums"], made["last"])
        self.waiting: dict[bytes, int] = {}
        self.longer: dict[bytes, int] = {}
        self.room = ROOM_FOR_LONGER

    def merged(self, words: list[bytes]) -> np.ndarray:
        """Tokens that the merges leave of each word."""
        data, starts, lengths = laid_out(words)
        ends = np.zeros(len(data), np.int64)
        for at, _ in merged_words(self.first[data], starts, lengths, self.table):
            ends[at] = 1
        return np.add.reduceat(ends, starts)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word; the words that are new are merged together."""
        out, inside = self.machine.run(*laid_out(words))
        outside = np.flatnonzero(~inside)
        if len(outside):
            found = [(self.waiting if len(w) <= LONGEST else self.longer).get(w) for w in map(words.__getitem__, outside)]
            out[outside] = [n or 0 for n in found]
            new = outside[[n is None for n in found]]
            if len(new):
                out[new] = self.merged([words[i] for i in new.tolist()])
                self._keep(words, new, out)
        return out

    def _keep(self, words, new, out):
        full = len(self.machine.sums) >= self.most
        for i in new.tolist():
            n = len(words[i])
            if n <= LONGEST and not full:
                self.waiting[words[i]] = int(out[i])
            elif LONGEST < n <= self.room:
                self.longer[words[i]] = int(out[i])
                self.room -= n
        # Each growth builds the table anew, so it waits for a share of what is there.
        if len(self.waiting) >= max(GROW_AFTER, len(self.machine.sums) // 16):
            counts = np.fromiter(self.waiting.values(), np.int64, len(self.waiting))
            self.machine = self.machine.grown(list(self.waiting), counts, self.most)
            self.waiting = {}


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where it prints, else the next one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def vocabulary(path: str | None = None) -> tuple[dict, list[str]]:
    """Merges and transducer as arrays, and the special strings, from a tokenizer file read on the driver."""
    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
        made = json.load(file)
    ids = made["model"]["vocab"]
    pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in made["model"]["merges"]]
    letters = byte_letters()
    arrays = {
        "left": np.array([ids[a] for a, _ in pairs], np.int32),
        "right": np.array([ids[b] for _, b in pairs], np.int32),
        "merged": np.array([ids[a + b] for a, b in pairs], np.int32),
        "rank": np.arange(len(pairs), dtype=np.int32),
        "first": np.array([ids[letters[b]] for b in range(256)], np.int32),
    }
    bytes_of = {letter: b for b, letter in letters.items()}
    added = {t["content"] for t in made["added_tokens"]}
    entries = [bytes(bytes_of[c] for c in entry) for entry in ids if entry not in added]
    arrays |= {"edges": np.zeros((0, 4), np.int64), "sums": np.zeros(1, np.int64), "last": np.zeros(1, np.int64)}
    empty = Counter(arrays)
    prefixes = sorted({e[:i] for e in entries if len(e) <= LONGEST for i in range(1, len(e) + 1)})
    machine = empty.machine.grown(prefixes, empty.merged(prefixes))
    arrays |= {k: getattr(machine, k).astype(np.int32) for k in ("edges", "sums", "last")}
    arrays["kinds"] = kinds_of_points()
    return arrays, [t["content"] for t in made["added_tokens"]]


def counts_of(texts: pa.Array, counter: Counter, special: list[str]) -> np.ndarray:
    """Tokens of each text of an array without nulls."""
    n_special = np.zeros(len(texts), np.int64)
    for s in special:
        n_special += pc.count_substring(texts, s).to_numpy(zero_copy_only=False)
    owners = np.arange(len(texts))
    pieces = texts
    if n_special.any():
        # A special string is one token and parts what stands around it.
        cut = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)))
        lists = [cut.split(t) if n else [t] for t, n in zip(texts.to_pylist(), n_special, strict=True)]
        n_special = np.array([len(x) - 1 for x in lists])
        owners = np.repeat(owners, [len(x) for x in lists])
        pieces = pa.array([p for x in lists for p in x], pa.string())
    joined = "\n".join(pieces.to_pylist()) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = pc.utf8_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
    breaks = np.zeros(len(points), bool)
    breaks[np.cumsum(lengths + 1) - 1] = True
    starts = word_starts(classes_of(points, breaks, counter.kinds))
    # Code point positions to byte positions of the joined text.
    widths = 1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000)
    at_byte = np.cumsum(widths) - widths
    where = np.flatnonzero(starts)
    offsets = np.r_[at_byte[where], at_byte[-1] + widths[-1]].astype(np.int32)
    data = joined.encode("utf-8", "surrogatepass")
    words = pa.Array.from_buffers(
        pa.binary(), len(where), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    ).dictionary_encode()
    tokens = counter.counts(words.dictionary.to_pylist())[words.indices.to_numpy()]
    tokens[breaks[where]] = 0
    owner = np.repeat(owners, lengths + 1)[where]
    return np.bincount(owner, tokens, len(texts)).astype(np.int64) + n_special


def counted(docs: DataFrame, path: str | None = None, most_states: int = MOST_STATES) -> DataFrame:
    """Add n_tokens to every row; a null or empty text has none.

    Special strings inside a text count as one token each, as in the library's default. The
    merges and the transducer (bounded tables) go along with the tasks; existing columns of that name are replaced.
    """
    arrays, special = vocabulary(path)
    kept: list[Counter] = []

    def count(rows: pa.StructArray, _) -> list[pa.Array]:
        if not kept:
            kept.append(Counter(arrays, most_states))
        texts = pc.fill_null(rows.field("text"), "")
        made = [counts_of(texts[a:b], kept[0], special) for a, b in text_slices(texts)]
        return [pa.array(np.concatenate(made) if made else [], pa.int64())]

    return mapped(docs, count, StructType().add("n_tokens", "long"))
