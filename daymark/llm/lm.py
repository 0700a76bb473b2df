"""Scores of texts under a gated recurrent language model.

Tokens are lower-case words and one end token per text. The vocabulary of the network holds the ``NET_WORDS`` most frequent tokens in
classes of ``CLASS`` words by frequency, and one class for all other words. A token's probability under the network is that of its class
times that of the word in its class, both softmaxes of the recurrent state; in the class of other words it is the smoothed share
of the word's exact count. The model's probability is the network's times ``mix`` plus that of the smoothed counts times the rest. Both
are distributions over all words, seen or not, so the mixture sums to one.

The network is trained by truncated backpropagation in numpy: a text's state runs on from window to window, gradients stay
inside a window. Every training text is used once: ``ROUNDS`` hashed parts are taken in turn, hashed groups of about ``GROUP_TOKENS`` tokens train a
replica each, and replicas and their step sizes are averaged by tokens after each round. Groups follow from ids and the size of the corpus,
not from partitions, so a cluster of another size learns the same network. ``mix`` is the best of ``GRID`` on all
training texts; the counts alone are in the grid, so a network that has not learned enough is left out. The trained network is run once over
each text, for all shares of the grid; the choice among them and the scores are both read from that run.

Scale: word counts are exact, over all training texts, summed per task and then by word. Texts are split once and written as token numbers, two
bytes each, which training and scoring read. The ``DICTIONARY`` most frequent words travel to the tasks, a bounded table; counts of
all other words are joined to the (text, word) pairs by word. After training, lanes of texts are run side by side and the state is carried over
the whole text. No task or driver holds more than a group's texts of a round, a batch of texts, or one network.
"""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymark.llm.common import map_arrow, remainder, table

#: The end token; it holds white space, so no word is equal to it.
END = "\n"
DICTIONARY = 1 << 17
NET_WORDS, CLASS = 4096, 64
CLASSES = NET_WORDS // CLASS
EMBED, STATE = 16, 24
WINDOW, LANES = 32, 1024
#: Rows of states whose chances are worked out together, and how many of them share a class's words in one product.
BLOCK, ROWS = 1024, 32
#: Training: rounds that the one pass over the training texts is split into, tokens of a group in all rounds, lanes, step size and the start of the
#: sums of squares that lower it.
ROUNDS, GROUP_TOKENS, TRAIN_LANES, RATE, START = 4, 1 << 23, 256, 0.3, 1e-2
#: Windows over which the step size rises to its full value.
WARM = 64
#: A training text longer than this, or than a sixteenth of it where a group is small, is learned in pieces, whose states start anew; scoring
#: carries the state over whole texts.
PIECE = 4096
#: Tokens and texts that are scored at once.
BATCH_TOKENS, BATCH_TEXTS = 1 << 22, 1 << 14
#: Tokens of the pieces that the mixture is judged on, and the shares of the network that it is chosen from.
JUDGED = 256
GRID = (0.0, 0.2, 0.4, 0.6, 0.75, 0.85, 0.92, 0.97, 1.0)
CHUNKS = 32
#: Bytes of texts that are split at once.
SLICE = 1 << 24
SHAPES = {
    "embed": (NET_WORDS + 1, EMBED), "into": (EMBED, 3 * STATE), "bias": (3 * STATE,), "over": (STATE, 3 * STATE),
    "class": (STATE, CLASSES + 1), "class_bias": (CLASSES + 1,), "word": (CLASSES, STATE, CLASS), "word_bias": (CLASSES, CLASS),
}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # on bytes: A-Z and ASCII white space only


def slices(texts: pa.Array):
    """Parts (start, texts) of at most ``SLICE`` bytes, or of one text; null texts are empty."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield at, texts.slice(at, stop - at)
        at = stop


def split_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, as in ``words_of``, and the number of the text that each is from."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, text = lists.flatten().cast(pa.string()), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty word there
    return (words, text) if real.all() else (words.filter(pa.array(real)), text[real])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all tokens of ``docs``, the end tokens included."""

    def merged(found: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(found).group_by("word", use_threads=False).aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])

    def count(batches):
        found: list[pa.Table] = []
        ends = waiting = 0
        for batch in batches:
            ends += batch.num_rows
            for _, texts in slices(batch.column(0)):
                words = split_texts(texts)[0].value_counts()
                found.append(pa.table([words.field(0), words.field(1)], ["word", "c"]))
                waiting += len(words)
                if waiting > 1_000_000:
                    found = [merged(found)]
                    waiting = found[0].num_rows
                    if waiting > 500_000:
                        yield from found[0].to_batches(1 << 16)
                        found, waiting = [], 0
        if ends:
            found.append(pa.table([pa.array([END]), pa.array([ends], pa.int64())], ["word", "c"]))
        if found:
            yield from merged(found).to_batches(1 << 16)

    return map_arrow(docs.select("text"), count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The bounded head of the counts; token 0 is the end, then words by decreasing count."""

    def __init__(self, counts: DataFrame):
        bins = counts.groupBy(F.floor(F.log2("c") * 64).alias("bin")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()  # some thousand at most
        self.tokens = sum(r["c"] for r in bins)
        self.distinct = sum(r["n"] for r in bins)
        room, least = DICTIONARY, None
        for row in sorted(bins, key=lambda r: -r["bin"]):
            if row["n"] > room:
                break
            room, least = room - row["n"], row["bin"]
        found = [] if least is None else counts.where(F.floor(F.log2("c") * 64) >= least).collect()
        head = sorted(((r["word"], r["c"]) for r in found), key=lambda r: (r[0] != END, -r[1], r[0]))
        if not head or head[0][0] != END:
            head.insert(0, (END, 0))
        self.words = pa.array([w for w, _ in head], pa.string())
        self.counts = np.array([c for _, c in head], np.float64)
        net = self.counts[:NET_WORDS]
        # Without training texts the end token is in the vocabulary though its count is zero.
        self.other_tokens = self.tokens - net.sum()
        self.other_distinct = self.distinct - int((net > 0).sum())

    def counted(self) -> np.ndarray:
        """The chance of each token of the network by the smoothed counts; the last one is that of all other words."""
        net = np.zeros(NET_WORDS)
        net[: min(NET_WORDS, len(self.counts))] = self.counts[:NET_WORDS]
        return np.append(net + 0.5, self.other_tokens + 0.5 * (self.other_distinct + 1)) / (self.tokens + 0.5 * (self.distinct + 1))


def initial(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Small random weights; the output biases are the logarithms of the counts, so the start is the unigram model."""
    rng = np.random.default_rng(7)
    net = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
    counts = np.zeros(NET_WORDS)
    counts[: min(NET_WORDS, len(vocabulary.counts))] = vocabulary.counts[:NET_WORDS]
    inside = (counts + 0.5).reshape(CLASSES, CLASS)
    net["word_bias"] = np.log(inside / inside.sum(axis=1, keepdims=True)).astype(np.float32)
    outside = [*inside.sum(axis=1), vocabulary.other_tokens + 0.5 * (vocabulary.other_distinct + 1)]
    net["class_bias"] = np.log(np.array(outside) / sum(outside)).astype(np.float32)
    net["bias"][:] = 0
    return net


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


#: Where the gates and the new value stand among the rows of ``cell_weights``, and among the columns of ``into``.
CELL = ((slice(0, 2 * STATE), slice(0, 2 * STATE)), (slice(3 * STATE, 4 * STATE), slice(2 * STATE, 3 * STATE)))


def cell_weights(net: dict) -> np.ndarray:
    """Weights [both gates, what the second gate lets through, the new value] of (state, embedded input, 1), so that a step is one product."""
    both = np.zeros((4 * STATE, STATE + EMBED + 1), net["over"].dtype)
    both[: 3 * STATE, :STATE] = net["over"].T
    for rows, columns in CELL:
        both[rows, STATE:-1], both[rows, -1] = net["into"].T[columns], net["bias"][columns]
    return both


def run_window(net: dict, inputs: np.ndarray, fresh: np.ndarray, state: np.ndarray, trace: dict | None = None):
    """States [steps, lanes, STATE] after each of the inputs [steps, lanes]; ``fresh`` marks the first token of a text, where the state is zero.

    Inside, lanes are the last axis, so that the parts of a gate stand together. ``trace`` takes what the gradients need.
    """
    steps, lanes = inputs.shape
    weights = cell_weights(net)
    embedded = net["embed"].take(inputs, axis=0)
    out = np.empty((steps, STATE, lanes), weights.dtype)
    kept = 1 if trace is None else steps
    met, parts = np.empty((kept, STATE + EMBED + 1, lanes), weights.dtype), np.empty((kept, 4 * STATE, lanes), weights.dtype)
    met[:, -1] = 1
    now = state.T
    anew = fresh.any(axis=1)
    for t in range(steps):
        own, part = met[t % kept], parts[t % kept]
        before, own[STATE:-1] = own[:STATE], embedded[t].T
        before[:] = now
        if anew[t]:
            before[:, fresh[t]] = 0
        np.matmul(weights, own, out=part)
        gates, lift, n = sigmoid(part[: 2 * STATE]), part[2 * STATE : 3 * STATE], part[3 * STATE :]
        n += gates[STATE:] * lift
        np.tanh(n, out=n)
        now = np.subtract(before, n, out=out[t])
        now *= gates[:STATE]
        now += n
    if trace is not None:
        trace["met"], trace["parts"] = met, parts
    return np.ascontiguousarray(out.transpose(0, 2, 1)), np.ascontiguousarray(now.T)


def softmax_parts(logits: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The logarithm of the chance of the wanted entry of each row, and the sum of each row of exp(logits), which is left in ``logits``."""
    if logits.max(initial=0) > 60:  # the sums stay far from the limits of a float
        logits -= logits.max(axis=1, keepdims=True)
    found = logits.take(wanted).astype(np.float64)
    np.exp(logits, out=logits)
    sums = logits @ np.ones(logits.shape[1], logits.dtype)
    found -= np.log(sums)
    return found, sums


def by_class(targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ``ROWS`` at a time, each lot of one class of the network's words: (class of each lot, row of each place in the lots, place of each row).

    The last lot of a class is filled up with its last row. Rows of other words have the place behind all lots.
    """
    classes = np.minimum(targets // CLASS, CLASSES).astype(np.uint8)
    order = np.argsort(classes, kind="stable")
    edges = np.searchsorted(classes[order], np.arange(CLASSES + 1))
    sizes = np.diff(edges)
    lots = -(-sizes // ROWS)
    kind = np.repeat(np.arange(CLASSES), lots)
    first = np.cumsum(lots) - lots
    place = np.full(len(targets), len(kind) * ROWS)
    place[order[: edges[-1]]] = np.arange(edges[-1]) + np.repeat(first * ROWS - edges[:-1], sizes)
    at = np.arange(len(kind))[:, None] * ROWS + np.arange(ROWS)
    at = np.minimum(at - (first * ROWS - edges[:-1])[kind, None], edges[1:][kind, None] - 1)
    return kind, order.take(at.ravel()), place


def log_chances(net: dict, states: np.ndarray, targets: np.ndarray, back: tuple | None = None) -> np.ndarray:
    """Natural logarithm of the chance of each target's class, and of the word in it for words of the network.

    ``back`` is (gradients, scale): then gradients of the summed loss times the scale are put there, and those of the states returned as well.
    Rows are taken ``BLOCK`` at a time, so that their chances stay in the cache of a core.
    """
    dtype = net["class"].dtype
    seen = np.ones((len(targets), STATE + 1), dtype)  # the biases are the weights of the last column
    seen[:, :STATE] = states
    chances = np.empty(len(targets))
    classes = np.minimum(targets // CLASS, CLASSES)
    weights = np.concatenate([net["class"], net["class_bias"][None]])
    if back:
        grad, scale = back
        through = np.empty((len(targets), STATE), dtype)
        made = np.zeros(weights.shape, dtype)
    for at in range(0, len(targets), BLOCK):
        own = slice(at, at + BLOCK)
        powers = seen[own] @ weights
        wanted = np.arange(len(powers)) * (CLASSES + 1) + classes[own]
        chances[own], sums = softmax_parts(powers, wanted)
        if back:
            powers.ravel()[wanted] -= sums
            share = (scale / sums)[:, None]
            made += (seen[own] * share).T @ powers
            np.multiply(powers @ net["class"].T, share, out=through[own])
    if back:
        grad["class"], grad["class_bias"] = made[:STATE], made[STATE]

    lot_class, row, place = by_class(targets)
    weights = np.concatenate([net["word"], net["word_bias"][:, None]], axis=1)
    in_class = np.append(np.empty(len(row)), 0.0)
    if back:
        real = np.zeros(len(row) + 1, dtype)
        real[place] = scale
        made = np.empty((len(lot_class), STATE + 1, CLASS), dtype)
        in_lots = np.zeros((len(row) + 1, STATE), dtype)
    lots = BLOCK // ROWS
    for at in range(0, len(lot_class), lots):
        kinds = lot_class[at : at + lots]
        own = slice(at * ROWS, (at + len(kinds)) * ROWS)
        mine, held = seen.take(row[own], axis=0), weights.take(kinds, axis=0)
        powers = (mine.reshape(len(kinds), ROWS, STATE + 1) @ held).reshape(-1, CLASS)
        wanted = np.arange(len(powers)) * CLASS + targets.take(row[own]) % CLASS
        in_class[own], sums = softmax_parts(powers, wanted)
        if back:
            powers.ravel()[wanted] -= sums
            share = (real[own] / sums)[:, None]
            mine *= share
            powers = powers.reshape(len(kinds), ROWS, CLASS)
            np.matmul(mine.reshape(len(kinds), ROWS, STATE + 1).transpose(0, 2, 1), powers, out=made[at : at + len(kinds)])
            np.multiply((powers @ held[:, :STATE].transpose(0, 2, 1)).reshape(-1, STATE), share, out=in_lots[own])
    chances += in_class.take(place)
    if not back:
        return chances
    for c, first, n in zip(*(a.tolist() for a in np.unique(lot_class, return_index=True, return_counts=True))):
        summed = made[first : first + n].sum(axis=0) if n > 1 else made[first]
        grad["word"][c], grad["word_bias"][c] = summed[:STATE], summed[STATE]
    through += in_lots.take(place, axis=0)
    return chances, through


def lanes_of(lengths: list[int], lanes: int) -> list[list[int]]:
    """Texts dealt to lanes of about equal length, longest lane first."""
    heap = [(0, i) for i in range(min(lanes, len(lengths)))]
    dealt: list[list[int]] = [[] for _ in heap]
    for text in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size, lane = heapq.heappop(heap)
        dealt[lane].append(text)
        heapq.heappush(heap, (size + lengths[text], lane))
    return sorted(dealt, key=lambda lane: -sum(lengths[i] for i in lane))


def pieces_of(texts: list[np.ndarray], piece: int) -> np.ndarray:
    """How many pieces of ``piece`` tokens each text has."""
    return np.array([-(-len(t) // piece) for t in texts], np.int64)


def windows(texts: list[np.ndarray], lanes: int, window: int, piece: int | None = None):
    """Yield (lanes still running, inputs, targets, fresh, text numbers), all [steps, lanes]; -1 as the text number is padding.

    With ``piece``, pieces of so many tokens are numbered through all texts instead of texts.
    """
    dealt = lanes_of([len(t) for t in texts], lanes)
    if not dealt:
        return
    sizes = np.array([sum(len(texts[i]) for i in lane) for lane in dealt])
    numbers = np.array([i for lane in dealt for i in lane], np.int32)
    y_all = np.concatenate([texts[i] for i in numbers]).astype(np.int32)
    lengths = np.array([len(texts[i]) for i in numbers])
    fresh_all = np.zeros(len(y_all), bool)
    fresh_all[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    x_all = np.concatenate([np.zeros(1, np.int32), y_all[:-1]])
    x_all[fresh_all] = 0
    number_all = np.repeat(numbers, lengths)
    if piece:
        counts = pieces_of(texts, piece)
        within = np.arange(len(y_all), dtype=np.int32)
        within -= np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
        within //= piece
        number_all = (np.cumsum(counts) - counts).astype(np.int32)[number_all]
        number_all += within
    starts = np.cumsum(sizes) - sizes
    for at in range(0, int(sizes[0]), window):
        running = int((sizes > at).sum())
        step = np.arange(at, min(at + window, int(sizes[0])))[:, None]
        short = step >= sizes[:running]
        place = np.where(short, 0, starts[:running] + step)
        x, y, fresh, number = (a.take(place) for a in (x_all, y_all, fresh_all, number_all))
        if short[-1].any():
            x[short], y[short], fresh[short], number[short] = 0, 0, False, -1
        yield running, x, y, fresh, number


def mixed_scores(net: dict, texts: list[np.ndarray], counted: np.ndarray | None, mixes: tuple, piece: int | None = None) -> np.ndarray:
    """Natural log-likelihoods [mix, text] of texts (net tokens, end included), the state carried over the whole text.

    ``counted`` holds the chances of the net tokens by counts, which take the share 1 - mix. With ``piece``, they are those of the pieces of
    so many tokens, text by text.
    """
    rows = int(pieces_of(texts, piece).sum()) if piece else len(texts)
    total = np.zeros((len(mixes), rows))
    longest = max(map(len, texts), default=1)
    lanes = max(128, min(LANES, sum(map(len, texts)) // longest))  # more would wait for the longest text
    state = np.zeros((min(lanes, len(texts)), STATE), net["over"].dtype)
    window = WINDOW * max(1, LANES // lanes)  # few lanes take longer windows, so that the softmaxes have as many rows
    for running, x, y, fresh, number in windows(texts, lanes, window, piece):
        states, state = run_window(net, x, fresh, state[:running])
        real = number.ravel() >= 0
        targets, who = y.ravel()[real], number.ravel()[real]
        chances = log_chances(net, states.reshape(-1, STATE)[real], targets)
        if counted is not None:
            own, plain = np.exp(chances), counted.take(targets)
        for row, mix in zip(total, mixes):
            row += np.bincount(who, chances if mix == 1 else np.log(mix * own + (1 - mix) * plain), minlength=rows)
    return total


def score_texts(net: dict, texts: list[np.ndarray], counted: np.ndarray | None = None, mix: float = 1.0) -> np.ndarray:
    """``mixed_scores`` for one mix; without the network where its share is zero."""
    if mix == 0:
        own = np.log(counted)
        return np.array([own[t].sum() for t in texts])
    return mixed_scores(net, texts, counted, (mix,))[0]


def gradients(net: dict, x, y, fresh, real, state, full: int | None = None) -> tuple[dict, np.ndarray, float]:
    """Gradients of the loss of one window, per token of a window of ``full`` tokens, the state behind it, and the summed loss."""
    steps, lanes = x.shape
    kind = net["over"].dtype
    trace: dict = {}
    states, after = run_window(net, x, fresh, state, trace)
    grad = {k: np.zeros(s, kind) for k, s in SHAPES.items()}
    scale = kind.type(1 / (full or WINDOW * TRAIN_LANES))
    states, targets = states.reshape(-1, STATE), y.ravel()
    if real.all():
        chances, through = log_chances(net, states, targets, (grad, scale))
    else:
        use = np.flatnonzero(real.ravel())
        chances, back = log_chances(net, states[use], targets[use], (grad, scale))
        through = np.zeros((steps * lanes, STATE), kind)
        through[use] = back
    through = np.ascontiguousarray(through.reshape(steps, lanes, STATE).transpose(0, 2, 1))
    parts, met = trace["parts"], trace["met"]
    z, r, lift, n = (parts[:, at : at + STATE] for at in range(0, 4 * STATE, STATE))
    for_n = (1 - z) * (1 - n * n)
    for_r = lift * r * (1 - r)
    weights = np.ascontiguousarray(cell_weights(net)[:, :-1].T)
    d_parts, d_embed = np.empty_like(parts), np.empty((EMBED, steps, lanes), kind)
    carried = np.zeros((STATE, lanes), kind)
    anew = fresh.any(axis=1)
    for t in range(steps - 1, -1, -1):
        dz, dr, d_lift, dn = d_parts[t].reshape(4, STATE, lanes)
        d = through[t]
        d += carried
        np.multiply(d, for_n[t], out=dn)
        np.multiply(dn, for_r[t], out=dr)
        np.multiply(dn, r[t], out=d_lift)
        d *= z[t]
        np.subtract(met[t, :STATE], n[t], out=dz)
        dz *= d
        dz *= 1 - z[t]
        d_met = weights @ d_parts[t]
        d_embed[:, t] = d_met[STATE:]
        carried = d
        carried += d_met[:STATE]
        if anew[t]:
            carried[:, fresh[t]] = 0
    made = (met @ d_parts.transpose(0, 2, 1)).sum(axis=0)
    grad["over"] = made[:STATE, : 3 * STATE]
    for rows, columns in CELL:
        grad["into"][:, columns], grad["bias"][columns] = made[STATE:-1, rows], made[-1, rows]
    inputs = x.ravel().astype(np.intp)
    for i, weights in enumerate(d_embed):
        grad["embed"][:, i] = np.bincount(inputs, weights.ravel(), minlength=NET_WORDS + 1)
    return grad, after, -float(chances.sum())


def train_texts(net: dict, texts: list[np.ndarray], squares: dict | None = None, done: float = WARM) -> int:
    """One pass of truncated backpropagation over the texts, by Adagrad; changes ``net``. Returns the number of tokens.

    ``done`` windows were learned from before.
    """
    squares = {k: np.full(s, START, np.float32) for k, s in SHAPES.items()} if squares is None else squares
    np.empty(1 << 24, np.uint8)  # once freed, malloc keeps smaller blocks for the next window rather than ask for new pages
    total = sum(map(len, texts))
    lanes = min(TRAIN_LANES, max(64, total // (WARM * WINDOW)))  # few texts make narrow windows rather than few of them
    piece = min(PIECE, max(PIECE // 16, total // lanes))  # so that no text is left running alone
    texts = [t[at : at + piece] for t in texts for at in range(0, len(t), piece)]
    state = np.zeros((min(lanes, len(texts)), STATE), np.float32)
    held: dict = {}
    waiting, left, full = 0, total, WINDOW * lanes
    for running, x, y, fresh, number in windows(texts, lanes, WINDOW):
        grad, state, _ = gradients(net, x, y, fresh, number >= 0, state[:running], full)
        n = int((number >= 0).sum())
        waiting, left = waiting + n, left - n
        held = {k: g + held[k] for k, g in grad.items()} if held else grad
        if 2 * waiting < full and left:
            continue  # windows that few lanes reach take a step together
        done += 1
        rate = np.float32(RATE * lanes / TRAIN_LANES * min(1.0, done / WARM))
        for k, g in held.items():
            by = np.multiply(g, g)
            squares[k] += by
            np.sqrt(squares[k], out=by)
            np.divide(g, by, out=by)
            by *= rate
            net[k] -= by
        held, waiting = {}, 0
    return total


def flat(net: dict) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in SHAPES])


def unflat(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[k] = values[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


def net_tokens(words: list[bytes], ids: dict) -> tuple[np.ndarray, np.ndarray]:
    """Dictionary numbers of the words (-1: not in it) and the end, and the network's tokens."""
    known = np.fromiter(map(ids.get, words, itertools.repeat(-1)), np.int64, len(words))
    known = np.append(known, 0)
    return known, np.where((known < 0) | (known >= NET_WORDS), NET_WORDS, known)


def turn_and_group(groups: int) -> tuple[Column, Column]:
    """The round and the group of a training text, by a hash of its id, or of its text where it has none."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    return F.pmod(F.xxhash64(key), F.lit(ROUNDS)).cast("int"), F.pmod(F.xxhash64(key, F.lit("group")), F.lit(groups)).cast("long")


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Rows (doc_id, turn, group, learn, judge, text) as token numbers of the network, with what the counts say of them.

    ``rare`` holds the words that are not in the dictionary, with their counts in the text; it is empty for rows that are not judged.
    """
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary.words, np.log10(vocabulary.counts + 0.5), vocabulary.counts > 0))
    names = ["doc_id", "turn", "group", "learn", "judge", "tokens", "n_tokens", "n_seen", "head", "n_other", "head_other", "rare"]

    def coded(texts: pa.Array, judge: np.ndarray) -> list[pa.Array]:
        head, weight, seen = sent.value
        words, text = split_texts(texts)
        found = pc.fill_null(pc.index_in(words, value_set=head), -1).to_numpy(zero_copy_only=False)
        sizes = np.bincount(text, minlength=len(texts)) + 1
        starts = np.cumsum(sizes) - sizes
        known = np.zeros(len(words) + len(texts), np.int64)  # the end token is 0
        known[np.arange(len(words)) + text] = found
        tokens = np.where((known < 0) | (known >= NET_WORDS), NET_WORDS, known).astype(np.uint16)
        offsets = np.append(starts, len(known)).astype(np.int32) * np.int32(2)
        value = np.append(weight, 0.0)[known]  # the last one is that of words that are not in the dictionary
        sums = [np.where(judge, np.add.reduceat(v, starts), 0) for v in
                (np.append(seen, False)[known].astype(np.int64), value, (tokens == NET_WORDS).astype(np.int64), np.where(known >= NET_WORDS, value, 0.0))]
        at = np.flatnonzero((found < 0) & judge[text])
        rare = pa.table([pa.array(text[at]), words.take(pa.array(at))], ["text", "word"]).group_by(["text", "word"], use_threads=False).aggregate([([], "count_all")])
        order = np.argsort(rare["text"].to_numpy(), kind="stable")
        rare = rare.take(pa.array(order)).combine_chunks()
        first = np.append(0, np.cumsum(np.bincount(rare["text"].to_numpy(), minlength=len(texts)))).astype(np.int32)
        column = lambda name, kind: pa.concat_arrays(rare[name].chunks or [pa.array([], kind)]).cast(kind)
        rare_words = pa.StructArray.from_arrays([column("word", pa.string()), column("count_all", pa.int64())], ["word", "n"])
        return [pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(tokens)]), pa.array(sizes, pa.int64()),
                *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(first), rare_words)]

    def run(batches):
        for batch in batches:
            judge = batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
            for at, texts in slices(batch.column(5)):
                same = [c.slice(at, len(texts)) for c in batch.columns[:5]]
                yield pa.RecordBatch.from_arrays([*same, *coded(texts, judge[at : at + len(texts)])], names)

    schema = ("doc_id long, turn int, group long, learn boolean, judge boolean, tokens binary, n_tokens long, n_seen long, head double, n_other long, "
              "head_other double, rare array<struct<word:string,n:bigint>>")
    return map_arrow(docs, run, schema)


def numbers(tokens: bytes) -> np.ndarray:
    return np.frombuffer(tokens, np.uint16)


def part_of(turn: int) -> Column:
    """Whether a row is of this round."""
    return turn_and_group(1)[0] == turn


def train(docs: DataFrame, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """The network learned from all rows of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(True).alias("learn"), F.lit(False).alias("judge"))
    return learned_net(table(encoded(dealt(rows, vocabulary), vocabulary), "lm-rows"), vocabulary)


def dealt(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The columns that ``encoded`` takes, with round and group."""
    turn, group = turn_and_group(-(-vocabulary.tokens // GROUP_TOKENS) or 1)
    return docs.select("doc_id", turn.alias("turn"), group.alias("group"), "learn", "judge", "text")


def learned_net(rows: DataFrame, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """The network learned from the rows of ``encoded`` that are marked to learn from.

    A task trains the replica of one group on its texts of the round, in the order of their ids, so the partitions do not matter.
    """
    sc = rows.sparkSession.sparkContext
    learn = rows.where("learn").select("turn", "group", "doc_id", "tokens")
    net, squares = flat(initial(vocabulary)), np.full(sum(int(np.prod(s)) for s in SHAPES.values()), START, np.float32)
    tokens_a_round = vocabulary.tokens / (-(-vocabulary.tokens // GROUP_TOKENS) or 1) / ROUNDS
    windows_a_round = max(min(tokens_a_round / (64 * WINDOW), WARM), tokens_a_round / (WINDOW * TRAIN_LANES))
    slots = max(1, math.isqrt(vocabulary.tokens // GROUP_TOKENS))
    schema = "group long, chunk int, tokens double, part binary"
    for turn in range(ROUNDS):
        sent = sc.broadcast((net, squares))
        done = turn * windows_a_round

        def replica(pdf):
            values, sums = sent.value
            own, own_squares = unflat(values.copy()), unflat(sums.copy())
            texts = [numbers(t) for t in pdf.sort_values(["doc_id", "tokens"], na_position="last")["tokens"]]
            tokens = float(train_texts(own, texts, own_squares, done))
            parts = [p.tobytes() for p in np.array_split(np.concatenate([flat(own), flat(own_squares)]), CHUNKS)]
            return pd.DataFrame({"group": int(pdf["group"].iloc[0]), "chunk": range(CHUNKS), "tokens": tokens, "part": parts})

        def averaged(pdf):
            weights = pdf["tokens"].to_numpy()
            mean = sum(w * np.frombuffer(p, np.float32).astype(np.float64) for w, p in zip(weights, pdf["part"])) / weights.sum()
            return pdf.iloc[:1].assign(tokens=weights.sum(), part=[mean.astype(np.float32).tobytes()])

        made = learn.where(F.col("turn") == turn).groupBy("group").applyInPandas(replica, schema)
        if slots > 1:  # so many replicas are averaged first, then these means
            made = made.groupBy("chunk", F.pmod("group", F.lit(slots)).alias("slot")).applyInPandas(lambda pdf: averaged(pdf[["group", "chunk", "tokens", "part"]]), schema)
        parts = [r["part"] for r in sorted(made.groupBy("chunk").applyInPandas(averaged, schema).collect(), key=lambda r: r["chunk"])]  # one network
        if parts:
            net, squares = np.split(np.concatenate([np.frombuffer(p, np.float32) for p in parts]), 2)
    return unflat(net)


def run_texts(rows: DataFrame, net: dict, counted: np.ndarray) -> DataFrame:
    """(row, learn, net, n, gain, square): the network run once over each text of ``encoded``, for every share of ``GRID``.

    ``net`` holds the base-10 log-likelihoods of the text; ``n`` is its number of pieces of ``JUDGED`` tokens, ``gain`` and ``square`` are the sums over
    them of the gain a token over the counts alone, and of its square.
    """
    sent = rows.sparkSession.sparkContext.broadcast((net, counted))

    def done(waiting: list[tuple]):
        ids, learn, texts = zip(*waiting)
        texts = [numbers(t) for t in texts]
        found = mixed_scores(sent.value[0], texts, sent.value[1], GRID, JUDGED)
        n = pieces_of(texts, JUDGED)
        first = np.cumsum(n) - n
        sizes = np.full(n.sum(), JUDGED)
        sizes[first + n - 1] = np.array([len(t) for t in texts]) - (n - 1) * JUDGED
        gains = (found - found[0]) / sizes
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(GRID)), pa.array(np.add.reduceat(v, first, axis=1).T.ravel()))
                 for v in (found / np.log(10), gains, gains**2)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(learn, pa.bool_()), lists[0], pa.array(n), *lists[1:]],
                                          ["row", "learn", "net", "n", "gain", "square"])

    def run(batches):
        # Many texts at once fill the lanes evenly; their tokens are bounded as well.
        waiting, size = [], 0
        for batch in batches:
            for row, learn, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                waiting.append((row, learn, tokens))
                size += len(tokens) // 2
                if len(waiting) >= BATCH_TEXTS or size >= BATCH_TOKENS:
                    yield done(waiting)
                    waiting, size = [], 0
        if waiting:
            yield done(waiting)

    schema = "row long, learn boolean, net array<double>, n long, gain array<double>, square array<double>"
    return map_arrow(rows.select("row", "learn", "tokens"), run, schema)


def best_mix(learn: DataFrame, gain: str, square: str) -> float:
    """The share of ``GRID`` with the surest gain over the counts alone, a token and averaged over pieces, from rows of ``run_texts``."""
    sums = [F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in (gain, square) for i in range(len(GRID))]
    found = learn.agg(F.sum("n").alias("n"), *sums).first()
    if not found["n"]:
        return 0.0

    def sure(i: int) -> float:
        """The mean gain over the counts, less its standard error."""
        mean = found[f"{gain}{i}"] / found["n"]
        return mean - math.sqrt(max(0.0, found[f"{square}{i}"] / found["n"] - mean**2) / found["n"])

    return max((round(sure(i), 9), -i, mix) for i, mix in enumerate(GRID))[2]


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """``score_learned`` of ``docs``, learned from the rows of another table."""
    rows = lambda df, learn: df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(learn).alias("learn"), F.lit(not learn).alias("judge"))
    return scored(rows(docs, False).unionByName(rows(training, True)))


def score_learned(docs: DataFrame, learn: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``, learned from the rows where ``learn`` holds.

    Scores are base-10 logarithms of the chance of the whole text with its end. A null text is empty: its only token is the end.
    Rows are scored one by one, so repeated rows and rows without an id are as good as any.
    """
    return scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"), F.lit(True).alias("judge")))


def scored(docs: DataFrame) -> DataFrame:
    """Scores of the rows (doc_id, text, learn, judge) that are judged."""
    counts = table(word_counts(docs.where("learn")), "word-counts")
    vocabulary = Vocabulary(counts)
    rows = table(encoded(dealt(docs, vocabulary), vocabulary).withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    runs = table(run_texts(rows, learned_net(rows, vocabulary), vocabulary.counted()), "lm-runs")
    mix = best_mix(runs.where("learn"), "gain", "square")
    judged = rows.where("judge")
    nets = runs.select("row", F.col("net")[GRID.index(mix)].alias("net"))
    rare = judged.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n").join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10(c + 0.5)).alias("rare_sum"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_seen"))
    out = judged.drop("rare", "tokens").join(nets, "row").join(sums, "row", "left").fillna(0.0, ["rare_sum"]).fillna(0, ["rare_seen"])
    whole = float(np.log10(vocabulary.tokens + 0.5 * (vocabulary.distinct + 1)))
    other = float(np.log10(vocabulary.other_tokens + 0.5 * (vocabulary.other_distinct + 1)))
    return out.select(
        "doc_id", "n_tokens", (F.col("n_seen") + F.col("rare_seen")).alias("n_known"), F.lit(int(vocabulary.tokens)).cast("long").alias("train_tokens"),
        (F.col("head") + F.col("rare_sum") - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("net") + F.col("head_other") + F.col("rare_sum") - F.col("n_other") * other).alias("score"))


def learning() -> Column:
    """Whether a row is learned from: remainder of the id not 1."""
    return remainder("doc_id", 5) != 1


def learned(docs: DataFrame) -> DataFrame:
    """The rows to learn from: remainder of the id not 1."""
    return docs.where(learning())
