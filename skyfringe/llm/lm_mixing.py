"""LM scoring by online logistic context mixing.

A text is its UTF-8 bytes, A-Z in lower case, and one end byte (0xFF, which UTF-8 never has). A byte is coded as the
binary decisions on its path through the Huffman tree of what follows the byte before it in training, and each decision
is predicted

* in the last four bytes and in the word so far, by hash from a table of what followed each such context in all
  training texts; the table has two slots for a training byte, up to ``2 ** MOST_BITS`` of them, and
* by a match: for every text Spark looks up the training text, other than itself, that shares most anchors with it
  (hashes of eight words in a row that are multiples of ``every``), and the byte that followed the last ``MATCH`` bytes
  in that text is expected again, the more the longer it has been right. This index has an entry for each anchor of each
  training text and grows with the corpus; none of it is broadcast beyond a counted number of rows.

Predictions are mixed in the logistic domain by weights that a gate (the decision's depth, the match's state) selects,
the mixture is refined by an adaptive map from (depth, confidence) to what came true, and weights and map learn from
every decision after it is coded, from the first byte of a text to its last. Mixing runs over many texts in step as
arrays, so texts of about the same length are dealt to the same unit of work; a text of any length takes memory for a
stretch of it at a time and time in proportion to its length.

Token counts of the base score cover all training texts. They are joined in two ways: tokens so frequent that at most
``frequent`` have their count are broadcast, and all others are joined by shuffle under a 64-bit hash.

Defined results: null text counts as empty (one end token and one end byte); without training texts every decision has
probability one half at the start and no token is known; repeated rows get a result each and are one another's self;
a null doc_id trains, as its remainder is none; further columns are left behind; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_small, materialize, text_rows
from .jaccard import mix, row_key, word_hashes
from .pretoken import portions

U = np.uint64
ORDERS = (4,)
CONTEXTS = len(ORDERS) + 1
#: First weights of the contexts, the match and a constant.
START = (0.5, 0.5, 1.0, 0.0)
INPUTS = len(START)
MOST_BITS = 24
CHUNKS = 64
END = 0xFF
SCALE = 12.0
#: The hash of the end token; words never have it but by chance.
END_TOKEN = np.int64(-0x61C8864680B583EB)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13, END]] = True
_P = U(0x9E3779B97F4A7C15)
_SPREAD = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77))
#: A match is of so many bytes.
MATCH = 16
#: How sure a match is taken to be, in units of 1 / SCALE, after so many that came true; much from 16 on.
STRENGTH = np.append(6 + 2 * np.arange(16), 60 + 4 * np.arange(16)).astype(np.int8)
STATES, BANDS = 3, 16


def _paths(counts: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
    """For each byte the decisions of its Huffman path: node, outcome, root of the node's subtree of three levels, and
    the node's place in it from 1 to 7."""
    heap = [(float(x), k) for k, x in enumerate(counts)]
    heapq.heapify(heap)
    child: list[tuple[int, int]] = []
    while len(heap) > 1:
        (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
        child.append((left, right))
        heapq.heappush(heap, (a + b, 255 + len(child)))
    paths: list = [[]] * 256
    todo = [(heap[0][1], [], 0, 0)]
    while todo:
        node, path, root, local = todo.pop()
        if node < 256:
            paths[node] = path
            continue
        if len(path) % 3 == 0:
            root, local = node, 1
        for bit in (0, 1):
            todo.append((child[node - 256][bit], [*path, (node, bit, root, local)], root, 2 * local + bit))
    return paths


class Codes:
    """The Huffman path of every byte after every byte, numbered 256 * (byte before) + byte. The decisions of a subtree
    of three levels have neighbouring slots."""

    def __init__(self, counts: np.ndarray):
        """``counts``: how often a byte follows a byte, 256 x 256."""
        overall = counts.sum(0) + 1e-3
        paths = []
        for row in counts:
            # What is rare counts a little, so that no path is much longer than fourteen decisions.
            paths += _paths(row + (row.sum() + 1) * (overall / overall.sum() / 64 + 1 / 8192))
        self.length = np.array([len(x) for x in paths], np.int32)
        self.most = int(self.length.max())
        cells = np.zeros((65_536, self.most, 4), np.int32)
        for k, path in enumerate(paths):
            cells[k, : len(path)] = path
        cells = cells.reshape(-1, 4)
        self.node, self.bit, self.local = cells[:, 0].astype(np.int16), cells[:, 1].astype(np.int8), cells[:, 3].astype(np.uint8)
        #: Subtrees on a path, and for each of them its hash.
        self.deep, self.subtrees = -(-self.most // 3), (self.length + 2) // 3
        tree = np.repeat(np.arange(65_536, dtype=np.uint32) >> np.uint32(8), self.deep)
        x = (cells.reshape(65_536, self.most, 4)[:, ::3, 2].reshape(-1).astype(np.uint32) + (tree << np.uint32(9))) * np.uint32(0x2C1B3C6D)
        self.root = (x ^ (x >> np.uint32(13))) * np.uint32(0x297A2D39)
        last = (np.arange(65_536) * self.most)[:, None] + np.clip(np.arange(3, 3 * self.deep + 3, 3), 1, self.length[:, None]) - 1
        #: The node of each subtree, from 2 to 15, that its last decision on the path leads to.
        self.reached = (2 * self.local[last] + self.bit[last].view(np.uint8)).reshape(-1)
        #: Of each decision its place among the slots of its path's subtrees, eight each, 256 times its outcome and 512 times its depth.
        depth = np.tile(np.arange(self.most, dtype=np.uint16), 65_536)
        self.about = depth // 3 * 8 + self.local + 256 * self.bit.astype(np.uint16) + 512 * depth

    def number(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        before = np.append(np.uint8(END), data[:-1])
        before[starts] = END
        return before.astype(np.int32) * 256 + data


def flat_bytes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes in lower case, where each text starts)."""
    sizes = np.array([len(x) for x in raw], np.int64)
    return _LOWER[np.frombuffer(b"".join(raw), np.uint8)], np.cumsum(sizes) - sizes


def _with_end(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") + b"\xff" for t in texts]


def _numbers_before(data: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` (4 or 8) bytes before each as one number, the nearest lowest, END before the first."""
    padded = np.concatenate([np.full(width, END, np.uint8), data])
    out = np.empty(len(data), f"u{width}")
    for j in range(min(width, len(data))):
        n = len(range(j, len(data), width))
        out[j::width] = padded[j : j + width * n].view(f">u{width}")
    return out


def _bytes_before(data: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """The k (at most 4) bytes before each as one number, the nearest lowest, END where the text has none."""
    sizes = np.diff(np.append(starts, len(data)))
    held = _numbers_before(data, 4)
    for j in range(k):
        held[starts[sizes > j] + j] |= np.uint32(0xFFFFFFFF << 8 * j & 0xFFFFFFFF)
    return held if k == 4 else held & np.uint32((1 << 8 * k) - 1)


def _mix_in_place(x: np.ndarray) -> np.ndarray:
    """``mix`` without arrays between."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
        x ^= x >> U(shift)
        if factor:
            x *= U(factor)
    return x


#: The mixed number of each byte at each of the first places in a word.
_IN_WORD = mix(np.tile(np.arange(256, dtype=U), 64) + np.repeat(np.arange(64, dtype=U), 256) * _P)


def context_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each context, the 32-bit hash of what stands before every byte."""
    out = np.empty((CONTEXTS, len(data)), np.uint32)
    for n, k in enumerate(ORDERS):
        x = _bytes_before(data, starts, k)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(12)
        x *= np.uint32(0x297A2D39)
        np.add(x, np.uint32(k), out=out[n])
    fresh = np.append(True, _BLANK[data[:-1]])[: len(data)]  # the first byte after a blank
    fresh[starts[starts < len(data)]] = True
    first = np.flatnonzero(fresh)
    sizes = np.diff(np.append(first, len(data)))
    place = np.arange(len(data)) - np.repeat(first, sizes)
    mixed = _IN_WORD.take(np.minimum(place, 63) * 256 + data)
    far = np.flatnonzero(place > 63)
    mixed[far] = mix(data[far].astype(U) + place[far].astype(U) * _P)
    total = np.append(U(0), np.cumsum(mixed)[:-1])[: len(data)]
    total -= np.repeat(total[first] - U(1), sizes)
    np.right_shift(_mix_in_place(total), U(32), out=total)
    out[-1] = total
    return out


def _histories(x: np.ndarray, place: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hash of the ``MATCH`` bytes before each and of the text's number) where a text has that many."""
    eight = _numbers_before(x, 8)
    at = np.flatnonzero(place >= MATCH)
    found = owner.take(at).astype(U)
    found *= _P
    found += eight.take(at)
    _mix_in_place(found)
    found += eight.take(at - 8)
    return at, _mix_in_place(found)


def expected_bytes(data: np.ndarray, starts: np.ndarray, refs: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte, what its text's reference had after the same ``MATCH`` bytes at their first place (-1: nothing),
    and how many such expectations, up to 31, came true in a row before it."""
    expected, sure = np.full(len(data), -1, np.int16), np.zeros(len(data), np.int8)
    sizes = np.diff(np.append(starts, len(data)))
    with_ref = [k for k, r in enumerate(refs) if r is not None and len(r) > MATCH and sizes[k] > MATCH]
    if not with_ref:
        return expected, sure
    ref, ref_starts = flat_bytes([refs[k] for k in with_ref])
    ref_sizes = np.diff(np.append(ref_starts, len(ref)))
    number = np.arange(len(with_ref))
    which = np.zeros(len(starts), bool)
    which[with_ref] = True
    mine = np.flatnonzero(np.repeat(which, sizes))
    x, x_sizes = data[mine], sizes[with_ref]
    place = lambda n: np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    known_at, known = _histories(ref, place(ref_sizes), np.repeat(number, ref_sizes))
    asked_at, asked = _histories(x, place(x_sizes), np.repeat(number, x_sizes))
    # Hash and position in one number each, so that both sides are sorted as plain numbers.
    low = U(max(len(ref), len(x)).bit_length())
    known = np.sort((known >> low << low) | known_at.astype(U))
    asked = np.sort((asked >> low << low) | asked_at.astype(U))
    found = known[np.minimum(np.searchsorted(known, asked >> low << low), len(known) - 1)]
    hit = found >> low == asked >> low
    position = U((1 << int(low)) - 1)
    guess = np.full(len(x), -1, np.int16)
    guess[(asked[hit] & position).astype(np.int64)] = ref[(found[hit] & position).astype(np.int64)]
    # A text's first bytes expect nothing, so no run goes on from text to text.
    at = np.arange(len(x))
    missed = np.maximum.accumulate(np.where(guess == x, 0, at))
    expected[mine] = guess
    sure[mine[1:]] = np.minimum(at - missed, 31)[:-1]
    return expected, sure


def _runs(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each item the numbers from ``first`` on, as many as its length."""
    out = np.repeat(first - np.cumsum(lengths, dtype=np.int64) + lengths, lengths)
    out += np.arange(len(out))
    return out


def _repeated(columns: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
    """Up to four columns of 32 bits, each row as often as its length says, moved as one number."""
    rows = np.empty((len(lengths), 4), columns[0].dtype)
    for k, column in enumerate(columns):
        rows[:, k] = column
    return np.repeat(rows.view(np.complex128).reshape(-1), lengths).view(rows.dtype).reshape(-1, 4)


def _subtrees(symbols: np.ndarray, hashes: list[np.ndarray], codes: Codes, bits: int) -> tuple[np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    """For every byte its number of subtrees; for every subtree of every byte its cell of the codes, and for each context
    its block of eight slots."""
    n = codes.subtrees.take(symbols)
    first = symbols * codes.deep - np.cumsum(n, dtype=np.int64) + n
    # What is below zero comes back by wrapping around.
    rows = _repeated([first.astype(np.uint32), *hashes], n)
    cell = (rows[:, 0] + np.arange(len(rows), dtype=np.uint32)).astype(np.int64)
    root = codes.root.take(cell)

    def blocks() -> Iterator[np.ndarray]:
        for k in range(len(hashes)):
            block = rows[:, 1 + k] ^ root
            block *= _SPREAD[k]
            block >>= np.uint32(32 - (bits - 3))
            yield block.astype(np.int64)

    return n, cell, blocks()


def table_rows(docs: DataFrame, codes: Codes, bits: int) -> DataFrame:
    """(chunk, part, data): for each task, how often each node of the table's blocks was where a path left it, in
    compressed chunks. A path counts once a subtree; ``_outcomes`` tells what its decisions count."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, any_rows = np.zeros(2 << bits, np.uint32), False
        for batch in batches:
            for some in portions(batch["text"], 50_000):
                data, starts = flat_bytes(_with_end(some))
                any_rows = True
                hashes, symbols = context_hashes(data, starts), codes.number(data, starts)
                for at in range(0, len(data), 50_000):
                    _, cell, blocks = _subtrees(symbols[at : at + 50_000].astype(np.int64), [h[at : at + 50_000] for h in hashes], codes, bits)
                    reached = codes.reached.take(cell)
                    for block in blocks:
                        block <<= 4
                        block += reached
                        np.add.at(counts, block, np.uint32(1))
        if any_rows:
            compress = zstandard.ZstdCompressor(level=1).compress
            part = TaskContext.get().partitionId()
            yield pd.DataFrame({"chunk": range(CHUNKS), "part": part, "data": [compress(x.tobytes()) for x in np.split(counts, CHUNKS)]})

    return docs.select("text").mapInPandas(count, "chunk int, part int, data binary")


def _add_counts(cells: pd.Series) -> np.ndarray:
    total = None
    for x in cells:
        counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint32)
        total = counts.astype(U) if total is None else np.add(total, counts, out=total)
    # Counts stop short of overflow, far beyond where they change a prediction.
    return np.minimum(total, U(0xFFFFFFFF), out=total).astype(np.uint32)


def _outcomes(reached: np.ndarray) -> np.ndarray:
    """Counts of both outcomes of each slot: a node of a block was come to as often as it or one below it was left."""
    counts = reached.reshape(-1, 16).astype(np.float64)
    for node in range(7, 1, -1):
        counts[:, node] += counts[:, 2 * node] + counts[:, 2 * node + 1]
    return counts.reshape(-1, 2)


def gather_tables(docs: DataFrame, codes: Codes, bits: int, *, fan: int = 32) -> np.ndarray:
    """The stretched probability of a set bit at each slot, as 8-bit numbers in units of 1 / SCALE. Counts of tasks are
    added in a tree, ``fan`` at a time."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        data = zstandard.ZstdCompressor(level=1).compress(_add_counts(pdf["data"]).tobytes())
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "part": [int(pdf["part"].iloc[0]) // fan], "data": [data]})

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = _outcomes(_add_counts(pdf["data"]))
        x = np.clip(np.round(np.log((counts[:, 1] + 0.1) / (counts[:, 0] + 0.1)) * SCALE), -127, 127).astype(np.int8)
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "data": [x.tobytes()]})

    rows = materialize(table_rows(docs, codes, bits))
    while (rows.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]) >= fan:
        summed = materialize(rows.groupBy("chunk", F.floor(F.col("part") / fan)).applyInPandas(add, "chunk int, part int, data binary"))
        discard(rows)
        rows = summed
    # The sums come back as one byte a slot, whatever the corpus.
    made = rows.groupBy("chunk").applyInPandas(finish, "chunk int, data binary").toPandas()
    discard(rows)
    table = np.zeros((CHUNKS, (1 << bits) // CHUNKS), np.int8)
    for chunk, data in zip(made["chunk"], made["data"], strict=True):
        table[chunk] = np.frombuffer(data, np.int8)
    return table.reshape(-1)


def decision_records(symbols: np.ndarray, hashes: list[np.ndarray], expected: np.ndarray, sure: np.ndarray, codes: Codes, table: np.ndarray) -> tuple[np.ndarray, ...]:
    """For some bytes: their number of decisions, and for each decision its inputs in units of 1 / SCALE, its depth, the
    state of the match, and its outcome."""
    return _records(symbols, hashes, expected, sure, np.zeros(len(symbols), np.int64), codes, table)


def _records(symbols: np.ndarray, hashes: list[np.ndarray], expected: np.ndarray, sure: np.ndarray, above: np.ndarray, codes: Codes, table: np.ndarray) -> tuple[np.ndarray, ...]:
    """``decision_records`` with what is ``above`` a byte added to the depths of its decisions."""
    symbols = symbols.astype(np.int64)
    lengths = codes.length.take(symbols)
    before = np.cumsum(lengths, dtype=np.int64) - lengths
    n, _, blocks = _subtrees(symbols, hashes, codes, int(len(table)).bit_length() - 1)
    # Where the expected byte comes true, so do all of its decisions.
    right = expected == symbols & 0xFF
    match = (4 * STRENGTH.take(sure).astype(np.int32) + 1 + (sure >= 16)) * right
    rows = _repeated([(symbols * codes.most - before).astype(np.int32), 8 * (np.cumsum(n, dtype=np.int32) - n), above, match], lengths)
    about = codes.about.take(rows[:, 0] + np.arange(len(rows)))
    place = (rows[:, 1] + (about & np.uint16(255))).astype(np.int64)
    # What the contexts say of a slot lies side by side, and all inputs of a decision are one number.
    eights = [table.view(U).take(block).view(np.uint8) for block in blocks]
    packed = eights[-1].astype(np.uint16)
    for eight in eights[-2::-1]:
        packed <<= np.uint16(8)
        packed |= eight
    packed = packed.take(place).astype(np.uint32)
    outcome = (about >> np.uint16(8)).astype(np.int8) & np.int8(1)
    match = (rows[:, 3] >> 2).astype(np.int8)
    match *= 2 * outcome - np.int8(1)
    packed |= match.view(np.uint8).astype(np.uint32) << np.uint32(8 * CONTEXTS)
    packed |= np.uint32(int(SCALE) << 8 * (CONTEXTS + 1))
    inputs = packed.view(np.int8).reshape(-1, INPUTS)
    depth = rows[:, 2] + (about >> np.uint16(9)).astype(np.int32)
    state = (rows[:, 3] & 3).astype(np.int8)
    wrong = np.flatnonzero((expected >= 0) & ~right)
    if len(wrong):
        size = lengths.take(wrong)
        which, at = _runs(before.take(wrong), size), _runs(np.zeros(len(wrong), np.int64), size)
        own = np.repeat(symbols.take(wrong), size)
        how, theirs = np.repeat(sure.take(wrong), size), (own & ~0xFF) | np.repeat(expected.take(wrong), size)
        # A path may end before this depth; then the expected byte is out of the game already.
        on = at < codes.length.take(theirs)
        on &= codes.node.take(theirs * codes.most + at) == codes.node.take(own * codes.most + at)
        which, how, theirs = which[on], how[on], (theirs * codes.most + at)[on]
        inputs[which, CONTEXTS] = (2 * codes.bit.take(theirs) - 1) * STRENGTH.take(how)
        state[which] = 1 + (how >= 16)
    return lengths, inputs, depth, state, outcome


def mixed_bits(raw: list[bytes], refs: list[bytes | None], codes: Codes, table: np.ndarray, *, rate: float = 0.02, at_once: int = 32_000, prepared: int = 50_000, lanes: int = 1_500) -> np.ndarray:
    """log2 of the probability of each byte string, which has its end byte already.

    The decisions of one byte have weights and map entries of their own, as these are kept by depth; so those of all
    texts' next bytes are one step, and the step learns what one decision after the other would.
    """
    sizes = np.array([len(x) for x in raw], np.int64)
    starts, size = np.cumsum(sizes) - sizes, int(sizes.sum())
    hashes = [np.empty(size, np.uint32) for _ in range(CONTEXTS)]
    symbols, expected, sure = np.empty(size, np.uint16), np.empty(size, np.int16), np.empty(size, np.int8)
    first = 0
    while first < len(raw):  # some texts at a time, so that what it takes to make these stays small
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + prepared)))
        data, begins = flat_bytes(raw[first:last])
        here = slice(int(starts[first]), int(starts[first]) + len(data))
        for h, made in zip(hashes, context_hashes(data, begins), strict=True):
            h[here] = made
        symbols[here] = codes.number(data, begins)
        expected[here], sure[here] = expected_bytes(data, begins, refs[first:last])
        first = last
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(raw))
    for some in np.array_split(order, -(-len(raw) // lanes)):
        out[some] = _mixed(starts[some], sizes[some], (symbols, hashes, expected, sure), codes, table, rate, at_once)
    return out


def _mixed(starts: np.ndarray, sizes: np.ndarray, data: tuple, codes: Codes, table: np.ndarray, rate: float, at_once: int) -> np.ndarray:
    """log2 of the probability of each of some texts, the longest first, side by side; ``data`` is that of all bytes."""
    symbols, hashes, expected, sure = data
    n = len(sizes)
    weights = np.empty((n * codes.most * STATES, INPUTS), np.float32)
    weights[:] = np.array(START, np.float32)
    as_rows = weights.view(np.complex128).reshape(-1)  # four weights move as one number
    refined = np.zeros(n * codes.most * BANDS, np.float32)
    total = np.zeros(n)
    units, rates = np.full(INPUTS, -1 / SCALE, np.float32), np.array([[rate / SCALE], [0.02]], np.float32)
    wide, middle, twice = np.float32(-BANDS / 24.001), np.float32(12 * BANDS / 24.001), np.complex64(1 + 1j)
    done = 0
    while done < sizes[0]:
        m = int(np.searchsorted(-sizes, -done, "left"))  # texts longer than what is done
        steps = min(max(4, at_once // m), int(sizes[0]) - done)
        live = np.searchsorted(-sizes[:m], -(done + np.arange(steps)), "left")
        lane = _runs(np.zeros(steps, np.int64), live)
        at = starts.take(lane)
        at += np.repeat(done + np.arange(steps), live)
        done += steps
        lengths, inputs, band, state, outcomes = _records(symbols.take(at), [h.take(at) for h in hashes], expected.take(at), sure.take(at), lane * codes.most, codes, table)
        until = np.cumsum(lengths, dtype=np.int64)
        ends = until[np.cumsum(live) - 1].tolist()
        which = band * STATES
        which += state
        band *= BANDS
        outcomes = outcomes.astype(np.float32)
        # What is mixed (first row) and refined (second), its sign turned, as a logistic function needs its exponential so.
        both, inverses = np.empty((2, len(which)), np.float32), np.empty((2, len(which)), np.float32)
        begin = 0
        for end in ends:
            x = inputs[begin:end].astype(np.float32)
            rows, here, inverse = which[begin:end], both[:, begin:end], inverses[:, begin:end]
            w = as_rows.take(rows).view(np.float32).reshape(-1, INPUTS)
            product = w * x
            mixed = product.dot(units)
            np.maximum(mixed, -12, out=mixed)
            np.minimum(mixed, 12, out=here[0])
            np.multiply(here[0], wide, out=mixed)
            mixed += middle
            slot = mixed.astype(np.int64)
            slot += band[begin:end]
            nudge = refined.take(slot)
            np.subtract(here[0], nudge, out=here[1])
            np.exp(here, out=inverse)
            inverse += 1
            error = np.reciprocal(inverse)
            np.subtract(outcomes[begin:end], error, out=error)
            error *= rates
            # Four times over, by pairs.
            pair, pairs = error[0] * twice, product.view(np.complex64)
            pairs[:, 0] = pair
            pairs[:, 1] = pair
            x *= product
            x += w
            as_rows[rows] = x.view(np.complex128).reshape(-1)
            nudge += error[1]
            refined[slot] = nudge
            begin = end
        # -log(p) of a 1 is log(1 + exp(-x)), and of a 0 that and x.
        lost = np.log(inverses[1])
        outcomes -= 1
        outcomes *= both[1]
        lost += outcomes
        total[:m] -= np.bincount(lane, np.diff(np.cumsum(lost, dtype=np.float64).take(until - 1), prepend=0), m)
    return total / np.log(2)


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes``, made for some texts at a time."""
    hashes, owners, at = [np.zeros(0, U)], [np.zeros(0, np.int64)], 0
    for some in portions(texts, 250_000):
        made, owner = word_hashes(some)
        hashes.append(made)
        owners.append(owner + at)
        at += len(some)
    return np.concatenate(hashes), np.concatenate(owners)


def _anchor_rows(docs: DataFrame, every: int, words: int = 8) -> DataFrame:
    """(anchor, row, held) of every text: the distinct hashes of its runs of ``words`` words that are multiples of ``every``."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factors = np.cumprod(np.full(words, _P, U))
        for batch in batches:
            at = 0
            for some in portions(batch["text"], 1_000_000):
                part = batch.iloc[at : at + len(some)]
                at += len(some)
                hashes, owner = _words(some)
                n = max(0, len(hashes) - words + 1)
                total = np.zeros(n, U)
                for k in range(words):
                    total += hashes[k : k + n] * factors[k]
                total = mix(total)
                use = (total % U(every) == 0) & (owner[:n] == owner[words - 1 : words - 1 + n])
                found = pd.DataFrame({"anchor": total[use].view(np.int64), "o": owner[:n][use]}).drop_duplicates()
                yield pd.DataFrame({"anchor": found["anchor"], "row": part["row"].to_numpy()[found["o"]], "held": part["__held"].to_numpy()[found["o"]]})

    return docs.select("row", "text", "__held").mapInPandas(made, "anchor long, row long, held boolean")


def reference_rows(rows: DataFrame, *, every: int = 16, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(row, ref): for each row (row, text, __held) that shares an anchor with a training row other than itself, the one
    that it shares most with; ties go to the larger row number."""
    anchors = materialize(_anchor_rows(rows, every))
    trained = F.when(~F.col("held"), F.col("row"))
    shared = anchors.groupBy("anchor").agg(F.min(trained).alias("lo"), F.max(trained).alias("hi"), F.count(F.lit(1)).alias("n")).where("n > 1 AND lo IS NOT NULL").drop("n")
    shared = materialize(shared)
    ref = F.when(F.col("lo") != F.col("row"), F.col("lo")).when(F.col("hi") != F.col("row"), F.col("hi"))
    met = join_small(anchors, shared, "anchor", "inner", rows=broadcast_rows).select("row", ref.alias("ref")).where("ref IS NOT NULL")
    best = met.groupBy("row", "ref").agg(F.count(F.lit(1)).alias("n")).groupBy("row").agg(F.max(F.struct("n", "ref"))["ref"].alias("ref"))
    best = materialize(best)
    discard(anchors, shared)
    return best


def reference_texts(rows: DataFrame, pairs: DataFrame, *, broadcast_rows: int = 1_000_000, per_salt: int = 1_000) -> DataFrame:
    """(row, ref_text) of ``pairs``. A text that is the reference of very many is sent under as many salts as it takes."""
    # Only references of more than a salt need a number, a row for at least ``per_salt`` texts.
    hot = pairs.groupBy("ref").agg(F.ceil(F.count(F.lit(1)) / per_salt).cast("int").alias("salts")).where("salts > 1")
    with_salts = lambda df: join_small(df, hot, "ref", "left", rows=broadcast_rows).withColumn("salts", F.coalesce("salts", F.lit(1)))
    wanted = pairs.select("ref").distinct()
    texts = join_small(rows.select(F.col("row").alias("ref"), F.col("text").alias("ref_text")), wanted, "ref", "left_semi", rows=broadcast_rows).dropDuplicates(["ref"])
    salted = with_salts(texts).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    asked = with_salts(pairs).withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")).drop("salts")
    return asked.join(salted, ["ref", "salt"]).select("row", "ref_text")


def score_documents(docs: DataFrame, held_out: Column, *, frequent: int = 200_000, unit_bytes: int = 6_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte and matched (whether a
    reference was found) of every text."""
    spark = docs.sparkSession
    rows = text_rows(docs.withColumn("__held", F.coalesce(held_out, F.lit(False))).withColumn("row", row_key(docs)), "__held", "row")
    training = rows.where(~F.col("__held"))

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for some in portions(batch["text"], 16_000_000):
                hashes, _ = _words(some)
                distinct, n = np.unique(np.append(hashes.view(np.int64), np.full(len(some), END_TOKEN)), return_counts=True)
                yield pd.DataFrame({"token": distinct, "c": n})

    counts = materialize(training.select("text").mapInPandas(tokens, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")))
    # A few hundred levels of counts, each a sixteenth of a doubling; the broadcast part is those that fit.
    levels = counts.groupBy(F.floor(16 * F.log2("c")).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect()
    known, total = sum(r["n"] for r in levels), sum(r["c"] for r in levels)
    from_level, held = 1 << 20, 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        held += r["n"]
        if held > frequent:
            break
        from_level = r["level"]
    common = counts.where(F.floor(16 * F.log2("c")) >= from_level).toPandas().sort_values("token")
    below = np.log10(total + known + 1.0)

    def count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(65_536, np.int64)
        for batch in batches:
            for some in portions(batch["text"], 250_000):
                data, starts = flat_bytes(_with_end(some))
                before = np.append(np.uint8(END), data[:-1])
                before[starts] = END
                n += np.bincount(before.astype(np.int64) * 256 + data, minlength=65_536)
        yield pd.DataFrame({"pair": np.flatnonzero(n), "n": n[n > 0]})

    by_pair = np.zeros(65_536)
    for r in training.select("text").mapInPandas(count_pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most 65,536 rows
        by_pair[r["pair"]] = r["n"]
    codes = Codes(by_pair.reshape(256, 256))
    bits = int(np.clip(np.ceil(np.log2(2 * by_pair.sum() + 1)), 12, MOST_BITS))
    shared = spark.sparkContext.broadcast((common["token"].to_numpy(np.int64), np.log10(common["c"].to_numpy() + 1.0), codes, gather_tables(training, codes, bits)))

    # Units of about ``unit_bytes`` with texts of about one length: classes of length, each in as many parts as it takes.
    # Units of long texts (8 kB and more) have twice that, as few side by side take longer.
    length_class = F.floor(3 * F.log2(F.octet_length("text") + 1.0)).cast("int")
    classes = {r["k"]: r["n"] for r in rows.groupBy(length_class.alias("k")).agg(F.sum(F.octet_length("text") + 1).alias("n")).collect()}  # at most 100 rows
    in_parts = lambda k: max(1, -(-classes.get(k, 0) // (unit_bytes if k < 39 else 2 * unit_bytes)))
    parts = F.array(*(F.lit(in_parts(k)) for k in range(max(classes, default=0) + 1)))
    unit = F.shiftleft(length_class.cast("long"), 40) + F.pmod(F.xxhash64("row"), F.element_at(parts, length_class + 1))
    placed = rows.select(F.col("doc_id").cast("long"), "text", "__held", "row", unit.alias("unit"))
    pairs = reference_rows(rows)
    references = reference_texts(rows, pairs).join(placed.select("row", F.col("unit").alias("for_unit")).distinct(), "row")

    def score(mine: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        frequent_tokens, frequent_logs, codes, table = shared.value
        texts = list(mine["text"])
        by_row = dict(zip(found["row"], found["ref_text"], strict=True))
        refs = [None if (r := by_row.get(k)) is None else r.encode("utf-8", "surrogatepass") + b"\xff" for k in mine["row"]]
        raw = _with_end(texts)
        hashes, owner = _words(texts)
        ids = np.append(hashes.view(np.int64), np.full(len(texts), END_TOKEN))
        owner = np.append(owner, np.arange(len(texts)))
        place = np.minimum(np.searchsorted(frequent_tokens, ids), max(0, len(frequent_tokens) - 1))
        is_frequent = frequent_tokens[place] == ids if len(frequent_tokens) else np.zeros(len(ids), bool)
        logs = np.where(is_frequent, frequent_logs[place] if len(frequent_tokens) else 0.0, 0.0)
        rare, rare_owner = ids[~is_frequent], owner[~is_frequent]
        o = np.lexsort((rare, rare_owner))
        rare, cuts = rare[o], np.searchsorted(rare_owner[o], np.arange(len(texts) + 1))
        return pd.DataFrame(
            {
                "doc_id": mine["doc_id"].astype("Int64").array,
                "held_out": mine["__held"].to_numpy(),
                "n_tokens": np.bincount(owner, minlength=len(texts)),
                "found": np.bincount(owner, is_frequent, len(texts)).astype(np.int64),
                "logs": np.bincount(owner, logs, len(texts)),
                "rare": [rare[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)],
                "bits": -mixed_bits(raw, refs, codes, table),
                "n_bytes": [len(x) for x in raw],
                "matched": [x is not None for x in refs],
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, found long, logs double, rare array<long>, bits double, n_bytes long, matched boolean"
    # A number that is asked for is kept: by size alone Spark would put many units into one task.
    tasks = min(50_000, sum(in_parts(k) for k in classes) or 1)
    mine, theirs = placed.repartition(tasks, "unit"), references.repartition(tasks, "for_unit")
    made = mine.groupBy("unit").cogroup(theirs.groupBy("for_unit")).applyInPandas(lambda a, b: score(a, b) if len(a) else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")]), schema)
    scored = materialize(made.withColumn("number", F.monotonically_increasing_id()))
    discard(pairs)
    # Rare tokens by shuffle: those that training has, with their counts.
    uses = scored.select("number", F.explode("rare").alias("token")).groupBy("token", "number").agg(F.count(F.lit(1)).alias("uses"))
    met = uses.join(counts, "token").groupBy("number").agg(F.sum("uses").alias("n"), F.sum(F.col("uses") * F.log10(F.col("c") + 1.0)).alias("more"))
    joined = scored.drop("rare").join(met, "number", "left")
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("found") + F.coalesce("n", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * float(below)).alias("base_score"),
        (-F.col("bits") * float(np.log10(2.0))).alias("score"),
        (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
        "matched",
    )
