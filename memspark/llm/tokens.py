"""Token counts of a byte-level BPE vocabulary by compiled finite-state transducers.

Two deterministic machines, both compiled from the vocabulary file:

1. The splitter reads code points by class (letter, number, space, ...) and marks where pieces
   begin; its transitions carry the marks. A long stream is cut into chunks; a chunk's state map
   says, for each state before it, the state after it. The maps compose by a parallel prefix scan
   and give each chunk its true first state, after which all chunks emit their marks side by side.
2. The counter reads a piece byte by byte; each of its transitions carries the number of tokens it
   adds (a transition can take some back). Which token ends a prefix's encoding depends on the
   tokens that end the shorter prefixes it could follow without merging with them (Berglund and van
   der Merwe, Formalizing BPE tokenization), so a state is what is left of those: for each earlier
   place from which a token could still come to its end, the place in the vocabulary's trie, the
   token that ends there, and how many tokens fewer there were. States are determinised as they are
   met, TABLE transitions at most are kept. Long pieces are cut into blocks: a block's map says,
   for a state before it, the state after it and the tokens added, and maps compose, so a block
   that comes again costs one look-up. Time is linear in the piece, however long.

Counts of pieces that come often are kept, MEMO at most.

Strings of added tokens inside a text are one token each and part the text, as is the default of
the public library for this file.

Cases: null text counts as empty; null ids and equal rows are counted like others; an empty table
gives an empty result; further columns are kept, names that clash are replaced.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

LIMIT = 1024
MEMO = 800_000
#: Transitions of the counter that are kept.
TABLE = 500_000
CHUNK = 1024
#: Bytes of a block of a long piece, and the maps of blocks that are kept.
BLOCK = 256
MAPS = 20_000
#: Code points read at once; a longer text is read alone.
AT_ONCE = 1 << 19

# classes of code points
LETTER, NUMBER, OTHER, BLANK, SPACE, QUOTE, SDMT, L, V, R, E, END = range(12)
# states: what the piece in progress is
(START, IN_LETTERS, IN_NUMBER, IN_OTHER, ONE_BLANK, ONE_SPACE, RUN_BLANK, RUN_SPACE,
 LONE_QUOTE, QUOTE_L, QUOTE_V, QUOTE_R, SHORTENED) = range(13)
HERE, BEFORE = 1, 2  # marks: a piece begins at this code point, at the one before it


@lru_cache(maxsize=1)
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) by state * 12 + class, for the pieces
    's 't 're 've 'm 'll 'd, ?letters, ?numbers, ?others, spaces not before a non-space, spaces."""
    letters = (LETTER, SDMT, L, V, R, E)
    kind_state = {**dict.fromkeys(letters, IN_LETTERS), NUMBER: IN_NUMBER, OTHER: IN_OTHER, QUOTE: IN_OTHER}
    nxt = np.zeros((13, 12), dtype=np.uint8)
    out = np.zeros((13, 12), dtype=np.uint8)

    def begin(c: int) -> int:
        return {BLANK: ONE_BLANK, SPACE: ONE_SPACE, QUOTE: LONE_QUOTE, END: START}.get(c, kind_state.get(c, START))

    for s in range(13):
        for c in range(12):
            state, mark = begin(c), HERE
            if c == END:
                mark |= BEFORE * (s in (QUOTE_L, QUOTE_V, QUOTE_R))
            elif s in (ONE_BLANK, RUN_BLANK, ONE_SPACE, RUN_SPACE):
                blank = s in (ONE_BLANK, RUN_BLANK)
                long = s in (RUN_BLANK, RUN_SPACE)
                if c in (BLANK, SPACE):
                    state, mark = (RUN_BLANK if c == BLANK else RUN_SPACE), 0
                elif blank:  # the last blank goes with what follows
                    state, mark = kind_state[c], BEFORE * long
                else:
                    mark = HERE | BEFORE * long
            elif s == IN_LETTERS and c in letters or s == IN_NUMBER and c == NUMBER or s == IN_OTHER and c in (OTHER, QUOTE):
                state, mark = s, 0
            elif s == LONE_QUOTE:
                if c == SDMT:
                    state, mark = SHORTENED, 0
                elif c in (L, V, R):
                    state, mark = {L: QUOTE_L, V: QUOTE_V, R: QUOTE_R}[c], 0
                elif c in (OTHER, QUOTE):
                    state, mark = IN_OTHER, 0
            elif s in (QUOTE_L, QUOTE_V, QUOTE_R):
                if c == (L if s == QUOTE_L else E):
                    state, mark = SHORTENED, 0
                else:  # not a short form: letters began at the code point before
                    inside = c in letters
                    state, mark = (IN_LETTERS if inside else state), BEFORE | HERE * (not inside)
            nxt[s, c], out[s, c] = state, mark
    return nxt.ravel(), out.ravel()


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            table[c] = LETTER
        elif k == "N":
            table[c] = NUMBER
    for c in [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        table[c] = SPACE
    for k, chars in ((BLANK, " "), (QUOTE, "'"), (SDMT, "sdmt"), (L, "l"), (V, "v"), (R, "r"), (E, "e")):
        for x in chars:
            table[ord(x)] = k
    return table


def marks(kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where pieces begin in a stream of classes, as positions."""
    nxt, out = splitter()
    n = len(kinds)
    lanes = max(1, -(-n // chunk))
    width = min(chunk, n) if lanes == 1 else chunk
    grid = np.full(lanes * width, END, dtype=np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(lanes, width).T)
    first = np.zeros(lanes, dtype=np.uint8)
    if lanes > 1:
        maps = np.tile(np.arange(13, dtype=np.uint8)[:, None], (1, lanes))
        for row in grid:
            maps = nxt[maps * np.uint8(12) + row]
        first[1:] = scan(maps)[START, :-1]
    state = first
    emitted = np.empty((width, lanes), dtype=np.uint8)
    for t, row in enumerate(grid):
        at = state * np.uint8(12) + row
        emitted[t] = out[at]
        state = nxt[at]
    emitted = emitted.T.ravel()
    begins = (emitted & HERE) > 0
    begins[:-1] |= (emitted[1:] & BEFORE) > 0
    return np.flatnonzero(begins[:n])


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (states, chunks), in log2(chunks) steps."""
    step = 1
    while step < maps.shape[1]:
        later = np.take_along_axis(maps[:, step:], maps[:, :-step].astype(np.intp), axis=0)
        maps = np.concatenate([maps[:, :step], later], axis=1)
        step *= 2
    return maps


#: What a vocabulary file may say besides its merges; anything else would change the counts.
_PLAIN = {
    "model": {"dropout": (None, 0.0), "continuing_subword_prefix": (None, ""), "end_of_word_suffix": (None, ""), "byte_fallback": (None, False), "ignore_merges": (None, False)},
    "pre_tokenizer": {"add_prefix_space": (False,), "use_regex": (None, True)},
}


def _check(spec: dict) -> None:
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel":
        raise ValueError("a byte-level BPE vocabulary is needed")
    if spec.get("normalizer"):
        raise ValueError("a normalizer is not supported")
    for part, options in _PLAIN.items():
        for name, allowed in options.items():
            if spec[part].get(name) not in allowed:
                raise ValueError(f"{part}.{name} = {spec[part].get(name)!r} is not supported")
    for t in spec.get("added_tokens") or []:
        if t.get("single_word") or t.get("lstrip") or t.get("rstrip"):
            raise ValueError(f"flags of the added token {t['content']!r} are not supported")


class Counter(dict):
    """Piece -> number of its tokens."""

    def __init__(self, vocabulary: str):
        super().__init__()
        spec = json.loads(vocabulary)
        _check(spec)
        byte_of = _byte_alphabet()

        def raw(s: str) -> bytes:
            return bytes(byte_of[c] for c in s)

        #: token -> its number: single bytes first, then in the order of the merges
        self.token: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int] | None] = [None] * 256
        self.merged: dict[tuple[int, int], int] = {}
        for pair in spec["model"]["merges"]:
            a, b = map(raw, pair if isinstance(pair, list) else pair.split(" "))
            n = len(self.halves)
            if a + b in self.token:
                raise ValueError("two merges make the same token")
            self.token[a + b] = n
            self.halves.append((self.token[a], self.token[b]))
            self.merged[self.token[a], self.token[b]] = n
        #: the trie: node * 256 + byte -> node; the token that ends at each node, or -1; which nodes go on
        self.child: dict[int, int] = {}
        self.ends, self.inner = [-1], [True]
        for t, n in self.token.items():
            node = 0
            for b in t:
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
                self.inner[node] = True
                node = nxt
            self.ends[node] = n
        self.apart: dict[tuple[int, int], bool] = {}
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.forget()

    def forget(self) -> None:
        """Back to the first state alone: nothing read, no token before."""
        self.states: list[tuple[tuple[int, int, int], ...]] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        #: state * 256 + byte -> next state * 256 + tokens added + 128
        self.table: dict[int, int] = {}
        self.maps: dict[tuple[int, bytes], tuple[int, int]] = {}

    def follows(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay as they are side by side.

        Merges are undone from the latest backwards, on either side of the border. They would have
        met if, before some undone merge, the two parts at the border merge with each other.
        """
        found = self.apart.get((a, b))
        if found is not None:
            return found
        x, y, before, found = a, b, len(self.halves), True
        while True:
            n = self.merged.get((x, y))
            if n is not None and n < before:
                found = False
                break
            # of equal numbers the left token was merged first, so the right one is undone first
            left = x > y and self.halves[x] is not None or self.halves[y] is None
            whole = self.halves[x if left else y]
            if whole is None:
                break
            before = x if left else y + 1
            if left:
                x = whole[1]
            else:
                y = whole[0]
        if len(self.apart) >= MEMO:
            self.apart.clear()
        self.apart[a, b] = found
        return found

    def transition(self, state: int, byte: int) -> int:
        """Compile one entry of the table."""
        child, ends, apart, follows = self.child.get, self.ends, self.apart.get, self.follows
        on = []
        last = -1
        for node, before, fewer in self.states[state]:  # from the longest candidate to the shortest
            node = child(node << 8 | byte)
            if node is None:
                continue
            if last < 0 and (token := ends[node]) >= 0:
                ok = True if before < 0 else apart((before, token))
                if ok or ok is None and follows(before, token):
                    last, added = token, 1 - fewer
            on.append((node, before, fewer))
        rest = tuple((node, before, fewer + added) for node, before, fewer in on if self.inner[node])
        new = (*rest, (0, last, 0))
        n = self.number.get(new)
        if n is None:
            n = self.number[new] = len(self.states)
            self.states.append(new)
        self.table[state << 8 | byte] = found = n << 8 | added + 128
        return found

    def run(self, state: int, piece: bytes) -> tuple[int, int]:
        """The state after a piece, and the tokens it adds."""
        get, key = self.table.get, state << 8
        count = -128 * len(piece)
        for b in piece:
            found = get(key | b)
            if found is None:
                found = self.transition(key >> 8, b)
            key = found & -256
            count += found & 255
        return key >> 8, count

    def long(self, piece: bytes) -> int:
        """Tokens of a piece whose blocks' maps are composed one after the other."""
        state = count = 0
        for at in range(0, len(piece), BLOCK):
            block = piece[at:at + BLOCK]
            found = self.maps.get((state, block))
            if found is None:
                if len(self.table) >= TABLE or len(self.maps) >= MAPS:
                    now = self.states[state]
                    self.forget()
                    state = self.number.setdefault(now, len(self.states))
                    if state == len(self.states):
                        self.states.append(now)
                found = self.maps[state, block] = self.run(state, block)
            state, more = found
            count += more
        return count

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        if len(self.table) >= TABLE:
            self.forget()
        raw = piece.encode("utf-8", "surrogatepass")
        if len(raw) > 4 * BLOCK:
            return self.long(raw)
        n = self.run(0, raw)[1]
        if len(piece) <= 64:
            self[piece] = n
        return n

    def split_added(self, text: str) -> tuple[int, list[str]]:
        """Added tokens in a text, and what is between them."""
        parts = [text]
        for a in self.added:
            if a in text:
                parts = [x for p in parts for x in p.split(a)]
        return len(parts) - 1, parts

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        total = np.zeros(len(texts), dtype=np.int64)
        stream: list[str] = []
        owner: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            n, parts = self.split_added(text)
            total[i] += n
            for p in parts:
                if p:
                    stream.append(p)
                    owner.append(i)
                    size += len(p) + 1
            if size >= AT_ONCE:
                self._count(stream, owner, total)
                stream, owner, size = [], [], 0
        if stream:
            self._count(stream, owner, total)
        return total

    def _count(self, stream: list[str], owner: list[int], total: np.ndarray) -> None:
        joined = "\n".join(stream) + "\n"
        kinds = _classes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        ends = np.cumsum([len(p) + 1 for p in stream]) - 1
        kinds[ends] = END
        begins = marks(kinds)
        begins = begins[kinds[begins] != END]
        part = np.searchsorted(ends, begins)
        stops = np.append(begins[1:], len(joined))
        stops = np.minimum(stops, ends[part])
        counts = [self[joined[a:b]] for a, b in zip(begins.tolist(), stops.tolist(), strict=True)]
        np.add.at(total, np.array(owner)[part], np.array(counts, dtype=np.int64))


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def compiled(vocabulary: str) -> Counter:
    return Counter(vocabulary)


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit. path: the vocabulary file, read on the driver."""
    spark = docs.sparkSession
    prepare(spark)
    with open(path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # one vocabulary: of fixed size
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    @F.pandas_udf("long")
    def counted(texts):
        import pandas as pd

        return pd.Series(compiled(shared.value).count(list(texts)), dtype="int64")

    out = docs.withColumn("n_bytes", F.octet_length(text).cast("long")).withColumn("n_tokens", counted(text))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
