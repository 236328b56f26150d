"""Vectorised byte-level BPE: pre-token boundaries by a transition-function scan, then cached pair merging.

The pre-tokenisation is the public pattern of the byte-level BPE vocabularies
(contractions, optional space + letters / numbers / other, white space with
the last blank left to the next piece).  It is expressed as a finite automaton
over codepoint classes; the automaton is run over all texts of a batch at once
by composing transition functions (composition is associative, so blocks are
scanned side by side and joined by a short scan over block functions).
"""

from __future__ import annotations

import base64
import heapq
import unicodedata

import numpy as np

# Symbols: what a character is, with the look-ahead of the pattern folded in.
LETTER, NUMBER, OTHER, SPACE_RUN, SPACE_GLUE, SPACE_LAST, QUOTE_1, QUOTE_2, BREAK = range(9)
# States: the kind of piece that is open after a character.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, GLUED, SHORT_1, SHORT_2 = range(8)

SEPARATOR = 0x110000  # one past the last codepoint: stands between two texts
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """step[symbol, state] -> state, opens[symbol, state] -> a new piece starts at this character."""
    step = np.zeros((9, 8), np.uint8)
    opens = np.ones((9, 8), bool)
    step[LETTER] = IN_LETTERS
    step[NUMBER] = IN_NUMBERS
    step[OTHER] = IN_OTHER
    step[SPACE_RUN] = IN_SPACE
    step[SPACE_GLUE] = GLUED
    step[SPACE_LAST] = FRESH
    step[QUOTE_1], step[QUOTE_2] = SHORT_1, SHORT_2
    step[BREAK] = FRESH
    opens[LETTER, [IN_LETTERS, GLUED, SHORT_1, SHORT_2]] = False
    step[LETTER, SHORT_1], step[LETTER, SHORT_2] = FRESH, SHORT_1
    opens[NUMBER, [IN_NUMBERS, GLUED]] = False
    opens[OTHER, [IN_OTHER, GLUED]] = False
    opens[SPACE_RUN, IN_SPACE] = False
    for q in (QUOTE_1, QUOTE_2):  # inside a run of other characters, or after a glued blank, it is no contraction
        opens[q, [IN_OTHER, GLUED]] = False
        step[q, [IN_OTHER, GLUED]] = IN_OTHER
    return step, opens


STEP, OPENS = _transitions()
_CLASSES: np.ndarray | None = None


def codepoint_classes() -> np.ndarray:
    """Class (LETTER, NUMBER, OTHER, SPACE_RUN or BREAK) of every codepoint; built once per process."""
    global _CLASSES
    if _CLASSES is None:
        of = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((of.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        table[_SPACES] = SPACE_RUN
        _CLASSES = np.append(table, np.uint8(BREAK))
    return _CLASSES


def symbols(points: np.ndarray) -> np.ndarray:
    """Symbol of each character of ``points`` (codepoints, texts separated by SEPARATOR)."""
    kind = codepoint_classes()[points]
    after = np.append(kind[1:], np.uint8(BREAK))
    out = kind.copy()
    last = (kind == SPACE_RUN) & (after <= OTHER)
    out[last] = np.where(points[last] == 32, SPACE_GLUE, SPACE_LAST)
    at = np.flatnonzero(points == 39)
    if len(at):
        padded = np.concatenate([points, np.full(2, SEPARATOR, points.dtype)])
        one, two = padded[at + 1], padded[at + 2]
        out[at[np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE_1
        pair = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        out[at[pair]] = QUOTE_2
    return out


def scan_states(symbol: np.ndarray, block: int = 1024) -> np.ndarray:
    """State before each character, by an associative scan over transition functions.

    Blocks are scanned side by side: first each block's whole function is
    composed, then the functions are joined to give each block's entry state,
    then the states inside the blocks follow.
    """
    n = len(symbol)
    rows = -(-n // block)
    grid = np.full(rows * block, BREAK, np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)  # one column per block
    function = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    flat = STEP.ravel()
    for row in grid:
        function = flat[(row.astype(np.int32) * 8)[:, None] + function]
    entry = np.zeros(rows, np.uint8)
    for i in range(1, rows):
        entry[i] = function[i - 1, entry[i - 1]]
    states = np.empty_like(grid)
    now = entry
    for i, row in enumerate(grid):
        states[i] = now
        now = flat[row.astype(np.int32) * 8 + now]
    return states.T.ravel()[:n]


def piece_starts(points: np.ndarray) -> np.ndarray:
    """True where a pre-token starts; separators start (and are) pieces of their own."""
    symbol = symbols(points)
    return OPENS[symbol, scan_states(symbol)]


class ByteBPE:
    """A byte-level BPE vocabulary (file of base64 token and rank per line) with a cache of merged pieces.

    The cache only saves work; it is emptied when it holds ``cache_size`` pieces.
    """

    def __init__(self, path: str, cache_size: int = 400_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.cache_size = cache_size
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.ids: list[int] = []
        self.sizes: list[int] = []

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece: repeatedly merges the adjacent pair of least rank, the leftmost first."""
        ranks = self.ranks
        if data in ranks:
            return [ranks[data]]
        if len(data) > 200:
            return self._merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same by a heap over a linked list, for pieces where the plain loop would be quadratic."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # end of the part that starts at i
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (r := ranks.get(data[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or not alive[end[i]] or end[end[i]] != stop:
                continue
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, id offsets per text, piece ends (characters within the text), piece offsets per text."""
        joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(lengths)
        points = np.insert(raw, ends, SEPARATOR)  # a separator after each text
        starts = np.flatnonzero(piece_starts(points))
        stops = np.append(starts[1:], len(points))
        doc = np.searchsorted(ends + np.arange(len(texts)), starts)  # separator k sits at ends[k] + k
        keep = points[starts] != SEPARATOR
        starts, stops, doc = starts[keep], stops[keep], doc[keep]
        a, b = (starts - doc).tolist(), (stops - doc).tolist()
        if len(self.index) > self.cache_size:
            self._reset()
        pieces = [joined[i:j] for i, j in zip(a, b)]
        for p in set(pieces).difference(self.index):
            got = self.merge(p.encode("utf-8", "surrogatepass"))
            self.index[p] = len(self.sizes)
            self.ids.extend(got)
            self.sizes.append(len(got))
        which = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        sizes = np.asarray(self.sizes, np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        size = sizes[which] if len(which) else np.zeros(0, np.int64)
        place = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(begin[which] - place[:-1], size) + np.arange(place[-1]) if len(which) else np.zeros(0, np.int64)
        ids = np.asarray(self.ids, np.int32)[take] if len(take) else np.zeros(0, np.int32)
        firsts = np.searchsorted(doc, np.arange(len(texts) + 1))
        piece_ends = (np.asarray(b, np.int64) - (ends - lengths)[doc]).astype(np.int32) if len(which) else np.zeros(0, np.int32)
        return ids, place[firsts], piece_ends, firsts

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``."""
        if not hasattr(self, "tokens"):
            self.tokens = {r: t for t, r in self.ranks.items()}
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")
