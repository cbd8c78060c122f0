"""Token counts by deterministic transducers compiled from a byte-level BPE tokenizer file.

Two machines run one after the other. The splitter reads characters: a character's class together with a look at the next
class; its transitions are annotated with the pre-tokens they begin. A batch of texts is cut into chunks; each chunk's map from
any state to its end state is computed for all chunks at once, the maps are composed by a parallel prefix scan, and a second
sweep from the then known states reads off the annotations.

The counter reads bytes. The encoding of a prefix ends with the one token that fits the encoding of what is before it, so its
state is the bytes that can still be the beginning of a token, and for each border among them the last token before it and the
number of tokens relative to now: a finite set, as tokens are. A transition is annotated with the change in the number of tokens.
A new pre-token starts it anew, so the map of a chunk (to its end state and the sum of its annotations) is constant but for
what stands before its first such place: the chunks' ends are swept at once, the heads when the state before them is known, and
a prefix sum over the annotations gives the counts of texts. So the maps of the splitter compose by the scan, those of the counter at the
beginnings of pre-tokens; within a pre-token of many chunks they are applied one after the other. Transitions are compiled when first met.
"""

from __future__ import annotations

import json
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, per_worker

#: Characters or bytes of a chunk; compiled transitions beyond which a worker starts anew; heads up to which they are read one by one.
CHUNK, KEPT, FEW = 64, 700_000, 8
#: A transition is stored as next state * SHIFT + change of the count + HALF_SHIFT.
SHIFT, HALF_SHIFT = 1024, 512

# Input symbols. LETTER1 can end a contraction alone, PAIR is a letter that begins "re", "ve" or "ll"; the LAST kinds of
# white space stand before a character that is none.
END, LETTER, LETTER1, PAIR, NUMBER, SPACE_LAST, SPACE, WHITE_LAST, WHITE, QUOTE, OTHER = range(11)
SYMBOLS = 11
# States: what the current pre-token is so far.
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_QUOTE, DONE, IN_WHITE, AFTER_SPACE, HALF = range(9)
STATES = 9


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and begun pre-tokens (0 or 1) by state and symbol."""
    go, begins = np.zeros((STATES, SYMBOLS), np.int32), np.ones((STATES, SYMBOLS), np.uint8)
    alone = {END: START, LETTER: IN_LETTERS, LETTER1: IN_LETTERS, PAIR: IN_LETTERS, NUMBER: IN_NUMBERS, SPACE_LAST: AFTER_SPACE, SPACE: IN_WHITE, WHITE_LAST: DONE, WHITE: IN_WHITE, QUOTE: IN_QUOTE, OTHER: IN_OTHER}
    for symbol, state in alone.items():
        go[:, symbol] = state

    def goes_on(state: int, to: int, *symbols: int) -> None:
        go[state, list(symbols)] = to
        begins[state, list(symbols)] = 0

    goes_on(IN_LETTERS, IN_LETTERS, LETTER, LETTER1, PAIR)
    goes_on(IN_NUMBERS, IN_NUMBERS, NUMBER)
    goes_on(IN_OTHER, IN_OTHER, OTHER, QUOTE)
    goes_on(IN_QUOTE, IN_OTHER, OTHER, QUOTE)
    goes_on(IN_QUOTE, DONE, LETTER1)
    goes_on(IN_QUOTE, HALF, PAIR)
    goes_on(HALF, DONE, LETTER, LETTER1, PAIR)
    goes_on(IN_WHITE, IN_WHITE, SPACE, WHITE)
    goes_on(AFTER_SPACE, IN_LETTERS, LETTER, LETTER1, PAIR)
    goes_on(AFTER_SPACE, IN_NUMBERS, NUMBER)
    goes_on(AFTER_SPACE, IN_OTHER, OTHER, QUOTE)
    return go, begins


#: Code points that are looked at; beyond it none is a letter, number or white space in the library's tables.
LOOKED_AT = 0x33480


def classes(pre_tokenizer) -> np.ndarray:
    """Symbol of every code point before the look at the next one; PAIR is given to r, v and l.

    Found by the library's own splitting: a character that stays with a letter before it is a letter, one that stays with a
    digit is a number, and white space is what then doesn't stay with punctuation.
    """
    every = [chr(c) for c in range(LOOKED_AT) if not 0xD800 <= c < 0xE000]
    out = np.full(0x110000, OTHER, np.uint8)
    out[[ord(c) for c in every]] = WHITE
    for first, symbol in (("!", OTHER), ("1", NUMBER), ("a", LETTER)):
        for i in range(0, len(every), 16384):
            text = "".join(f"{first}{c}\n" for c in every[i : i + 16384])
            out[[ord(text[a + 1]) for _, (a, b) in pre_tokenizer.pre_tokenize_str(text) if a % 3 == 0 and b == a + 2]] = symbol
    for chars, symbol in (("stmd", LETTER1), ("rvl", PAIR), (" ", SPACE), ("'", QUOTE)):
        out[[ord(c) for c in chars]] = symbol
    return out


class Splitter:
    def __init__(self, table: np.ndarray):
        self.table = table
        go, begins = splitter()
        self.go, self.begins = (go * SYMBOLS).ravel(), begins.ravel()

    def symbols(self, text: str, ends: np.ndarray) -> np.ndarray:
        """Of each character; at ends stand the separators of texts."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.table[codes]
        sym[ends] = END
        follows = np.append(sym[1:], np.uint8(END))
        code2 = np.append(codes[1:], np.uint32(0))
        pairs = (sym == PAIR) & ~(((code2 == ord("e")) & (codes != ord("l"))) | ((code2 == ord("l")) & (codes == ord("l"))))
        sym[pairs] = LETTER
        last = (follows != END) & (follows != SPACE) & (follows != WHITE)
        sym[last & (sym == SPACE)] = SPACE_LAST
        sym[last & (sym == WHITE)] = WHITE_LAST
        return sym

    def starts(self, sym: np.ndarray) -> np.ndarray:
        """Places where a pre-token, or a separator, begins."""
        n = len(sym)
        rows = -(-n // CHUNK)
        grid = np.full(rows * CHUNK, END, np.uint8)
        grid[:n] = sym
        grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)  # a row for each place in the chunks
        maps = np.repeat((np.arange(STATES, dtype=np.int32) * SYMBOLS)[:, None], rows, axis=1)
        for column in grid:
            maps = self.go[maps + column]
        maps = (maps // SYMBOLS).T
        step = 1
        while step < rows:  # after it, row i is the map of chunks 0 to i
            maps = np.concatenate([maps[:step], np.take_along_axis(maps[step:], maps[:-step], axis=1)])
            step *= 2
        state = np.zeros(rows, np.int32)
        state[1:] = maps[:-1, START] * SYMBOLS
        out = np.empty((CHUNK, rows), np.uint8)
        for j, column in enumerate(grid):
            at = state + column
            out[j] = self.begins[at]
            state = self.go[at]
        return np.flatnonzero(out.T.ravel()[:n])

    def begins_of(self, texts: list[str]) -> tuple[str, np.ndarray]:
        """The texts with a separator after each, and the characters that begin a pre-token or are a separator."""
        text = "\n".join([*texts, ""])
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        return text, self.starts(self.symbols(text, ends))

    def split(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """All pre-tokens of the texts, one after the other, and the text number of each."""
        text, at = self.begins_of(texts)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        to = np.append(at[1:], len(text))
        owner = np.searchsorted(ends, at)
        real = at != ends[owner]
        return [text[a:b] for a, b in zip(at[real].tolist(), to[real].tolist(), strict=True)], owner[real]


class Counter:
    """Byte-level transducer from a pre-token to its number of tokens."""

    def __init__(self, merges: dict[tuple[bytes, bytes], int], vocab: set[bytes]):
        self.merges, self.vocab = merges, vocab
        self.beginnings = {t[:n] for t in vocab for n in range(1, len(t))}
        self.made = {a + b: (a, b, rank) for (a, b), rank in merges.items()}
        self.spines: dict[tuple[bytes, int], list[tuple[bytes, float]]] = {}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.forget()

    def forget(self) -> None:
        """State 0 is the start: nothing read. Of a state: its bytes, and the last token and relative count at each border."""
        self.states: list[tuple[bytes, tuple[bytes, ...], tuple[int, ...]]] = [(b"", (b"",), (0,))]
        self.number = {self.states[0]: 0}
        self.keys, self.go, self.known = np.full(1 << 12, -1, np.int64), np.zeros(1 << 12, np.int64), 0
        self.walked: dict[int, int] = {}
        self.fits.clear()

    def spine(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """What stands at one border of a token while it is built (side 1: its right border), and the rank that ends each."""
        found = self.spines.get((token, side))
        if found is None:
            part, rank = self.made.get(token), float("inf")
            found = [(token, rank)]
            if part:
                inner = self.spine(part[side], side)
                found = [*inner[:-1], (inner[-1][0], part[2]), (token, rank)]
            self.spines[token, side] = found
        return found

    def fit(self, a: bytes, b: bytes) -> bool:
        """Whether a followed by b is the encoding of their bytes: an encoding is one whose neighbours all fit.

        The two are built side by side in the order of ranks. They fit if what meets at the border never merges: its rank
        would have to come before the next merge on either side, where of equal ranks the left one is first.
        """
        found = self.fits.get((a, b))
        if found is None:
            left, right, i, j, found = self.spine(a, 1), self.spine(b, 0), 0, 0, True
            while found:
                (x, until_x), (y, until_y) = left[i], right[j]
                rank = self.merges.get((x, y))
                if rank is not None and rank < until_x and rank <= until_y:
                    found = False
                elif until_x == until_y == float("inf"):
                    break
                elif until_x <= until_y:
                    i += 1
                else:
                    j += 1
            self.fits[a, b] = found
        return found

    def compile(self, state: int, byte: int) -> int:
        """The transition of a state by a byte: the last token is the longest one that fits the last token before it."""
        text, last, count = self.states[state]
        text += bytes([byte])
        n = len(text)
        for k in range(n, 0, -1):
            token = text[n - k :]
            if token in self.vocab and (len(last[n - k]) == 0 or self.fit(last[n - k], token)):
                change = count[n - k] + 1
                break
        else:
            raise ValueError("a byte is missing from the vocabulary")
        keep = next((k for k in range(n, 0, -1) if text[n - k :] in self.beginnings), 0)
        new = text[n - keep :], (*last, token)[n - keep :], (*(c - change for c in count), 0)[n - keep :]
        to = self.number.get(new)
        if to is None:
            to = self.number[new] = len(self.states)
            self.states.append(new)
        if not -HALF_SHIFT <= change < HALF_SHIFT:
            raise ValueError("a change of the count is too large")
        return to * SHIFT + change + HALF_SHIFT

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in the table of transitions, or the free one where it belongs; the next place is tried while it is taken."""
        mask = len(self.keys) - 1
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & mask
        held = self.keys[at]
        taken = np.flatnonzero((held != keys) & (held >= 0))
        while len(taken):
            at[taken] = (at[taken] + 1) & mask
            held = self.keys[at[taken]]
            taken = taken[(held != keys[taken]) & (held >= 0)]
        return at

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds transitions; of several that want one free place, one after the other gets it."""
        while len(keys):
            at = self.slots(keys)
            self.keys[at], self.go[at] = keys, values
            lost = np.flatnonzero(self.keys[at] != keys)
            won = np.setdiff1d(np.arange(len(keys)), lost)
            self.go[at[won]] = values[won]
            keys, values = keys[lost], values[lost]

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Transitions as they are stored; those that are met for the first time are compiled."""
        keys = state.astype(np.int64) * 256 + byte
        at = self.slots(keys)
        new = np.flatnonzero(self.keys[at] < 0)
        if len(new):
            found = np.unique(keys[new])
            values = np.array([self.compile(pair >> 8, pair & 255) for pair in found.tolist()], np.int64)
            self.known += len(found)
            if 2 * self.known > len(self.keys):
                old, went = self.keys[self.keys >= 0], self.go[self.keys >= 0]
                self.keys = np.full(1 << int(4 * self.known).bit_length(), -1, np.int64)
                self.go = np.zeros(len(self.keys), np.int64)
                self.add(old, went)
            self.add(found, values)
            at = self.slots(keys)
        return self.go[at]

    def walk(self, state: int, data: list[int]) -> tuple[int, list[int]]:
        """End state and changes of the count along bytes, one after the other: what a long pre-token needs, whose chunks wait for each other."""
        get, out = self.walked.get, []
        for byte in data:
            key = state << 8 | byte
            found = get(key)
            if found is None:
                found = self.walked[key] = int(self.step(np.array([state]), np.array([byte]))[0])
            state, change = divmod(found, SHIFT)
            out.append(change - HALF_SHIFT)
        return state, out

    def changes(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Change of the count at each byte; starts: the bytes that begin a pre-token, the first one among them."""
        n = len(raw)
        rows = -(-n // CHUNK)
        grid, begins = np.zeros(rows * CHUNK, np.uint8), np.zeros(rows * CHUNK, bool)
        grid[:n], begins[starts] = raw, True
        begins[n:] = True  # what fills the last chunk up
        first = np.where(begins.reshape(rows, CHUNK).any(axis=1), begins.reshape(rows, CHUNK).argmax(axis=1), CHUNK)
        grid, begins = np.ascontiguousarray(grid.reshape(rows, CHUNK).T), np.ascontiguousarray(begins.reshape(rows, CHUNK).T)
        out = np.zeros((CHUNK, rows), np.int16)
        end = np.zeros(rows, np.int64)
        known = np.flatnonzero(first < CHUNK)
        # from the first start of each chunk on: the constant part of its map
        order = known[np.argsort(first[known], kind="stable")]
        until = np.searchsorted(first[order], np.arange(CHUNK), "right")
        for j in range(CHUNK):
            at = order[: until[j]]
            found = self.step(np.where(begins[j, at], 0, end[at]), grid[j, at])
            end[at] = found // SHIFT
            out[j, at] = found % SHIFT - HALF_SHIFT
        # the heads, from the end state of the chunk before; chunks without a start one after the other
        wait = np.flatnonzero(first > 0)
        depth = np.zeros(rows, np.int32)
        whole = first == CHUNK
        for r in np.flatnonzero(whole).tolist():
            depth[r] = depth[r - 1] + 1 if r and whole[r - 1] else 0
        # a head follows what is before it: first those after a known end, then each after its predecessor
        level = np.where(whole, depth, np.where(np.append(False, whole[:-1]), np.append(0, depth[:-1]) + 1, 0))
        wait = wait[np.argsort(level[wait], kind="stable")]
        for group in np.split(wait, np.flatnonzero(np.diff(level[wait])) + 1):
            if len(group) <= FEW:
                for r in group.tolist():
                    m = int(first[r])
                    state, out[:m, r] = self.walk(int(end[r - 1]), grid[:m, r].tolist())
                    if m == CHUNK:
                        end[r] = state
                continue
            state = end[group - 1]
            group, state = group[np.argsort(-first[group], kind="stable")], state[np.argsort(-first[group], kind="stable")]
            until = np.searchsorted(-first[group], -np.arange(first[group[0]]), "left")
            for j, m in enumerate(until.tolist()):
                found = self.step(state[:m], grid[j, group[:m]])
                state[:m] = found // SHIFT
                out[j, group[:m]] = found % SHIFT - HALF_SHIFT
            done = first[group] == CHUNK
            end[group[done]] = state[done]
        return out.T.ravel()[:n]


class Machine:
    """Both transducers: number of tokens of each of a list of texts."""

    def __init__(self, merges: dict[tuple[bytes, bytes], int], vocab: set[bytes], table: np.ndarray):
        self.splitter, self.counter = Splitter(table), Counter(merges, vocab)
        self.separator = int(self.counter.changes(np.array([10], np.uint8), np.array([0]))[0])

    def count(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0, np.int64)
        if self.counter.known > KEPT:
            self.counter.forget()
        text, at = self.splitter.begins_of(texts)
        raw = np.frombuffer(text.encode(), np.uint8)
        byte_of = np.flatnonzero((raw & 0xC0) != 0x80) if len(raw) != len(text) else None  # of each character
        total = np.append(0, np.cumsum(self.counter.changes(raw, at if byte_of is None else byte_of[at]), dtype=np.int64))
        ends = np.cumsum([len(t.encode()) + 1 for t in texts])
        return np.diff(total[np.append(0, ends)]) - self.separator


def read_tokenizer(path: str) -> tuple[dict[tuple[bytes, bytes], int], set[bytes], list[str]]:
    """Merges by rank, vocabulary as bytes, and added tokens of a byte-level BPE file; ValueError for another kind."""
    spec = json.loads(Path(path).read_text())
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = not model.get("dropout") and not model.get("ignore_merges") and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or not plain:
        raise ValueError("not a plain byte-level BPE tokenizer")
    added = spec.get("added_tokens", [])
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("added tokens with conditions")
    # the format writes printable bytes as themselves and the others as U+0100 and on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}
    special = {t["content"] for t in added}
    raw = lambda s: bytes(byte[c] for c in s)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}, {raw(t) for t in model["vocab"] if t not in special}, sorted(special, key=len, reverse=True)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null or empty text has no bytes and no tokens. The strings of added tokens count as one token wherever they stand.
    Very long texts are counted whole; equal rows give equal rows; other columns are not read; no rows give no rows.
    """
    from tokenizers import Tokenizer

    merges, vocab, special = read_tokenizer(path)
    table = classes(Tokenizer.from_file(path).pre_tokenizer)
    sent = docs.sparkSession.sparkContext.broadcast((merges, vocab, special, table))  # fixed size: vocabulary, code points
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    own = uuid.uuid4().hex

    def make():
        import re

        merges, vocab, special, table = sent.value
        count = per_worker(own, lambda: Machine(merges, vocab, table)).count
        cut = re.compile("|".join(map(re.escape, special))).split if special else lambda t: [t]

        def rows(ids, texts):
            texts = [t or "" for t in texts]
            parts = [cut(t) for t in texts]
            each = count([s for p in parts for s in p])
            owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
            n = np.bincount(owner, each, len(texts)).astype(np.int64) if texts else each
            n = (n + [len(p) - 1 for p in parts]).tolist() if texts else []
            return [ids, [len(t.encode()) for t in texts], n, [x > limit for x in n]]

        return rows

    return map_rows(docs.select(doc_id, text), make, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean", text)
