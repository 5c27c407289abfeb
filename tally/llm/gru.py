"""A gated recurrent language model over units, in numpy.

The output softmax is factored: a unit's class first, then the unit inside its class. Units
are numbered by frequency and a class holds consecutive ones, so both softmaxes are about
as wide as the square root of the number of units. Biases start at the units' shares, so
an untrained model is the unigram model. Training is truncated backpropagation through
time with Adam; scoring carries the state across windows from the start of a document to
its end.

States and gates are streams x units, held by column: numpy's inner loops run over the
streams, and the gates' parts are blocks of memory.
"""

from __future__ import annotations

import functools
import heapq
import math
from dataclasses import dataclass

import numpy as np

FLOAT = np.float32
RATE = 1e-2
#: Parallel streams of training, at most and at least, and the tokens that each should have.
STREAMS, FEW_STREAMS, STREAM_TOKENS = 384, 16, 2_000


@dataclass(frozen=True)
class Shape:
    units: int
    hidden: int = 32
    embedding: int = 24

    @property
    def width(self) -> int:
        """Units in a class."""
        return max(1, int(np.ceil(np.sqrt(self.units))))

    @property
    def classes(self) -> int:
        return -(-self.units // self.width)

    def parts(self) -> dict[str, tuple[int, ...]]:
        h, d = self.hidden, self.embedding
        return {"embed": (self.units, d), "wx": (d, 3 * h), "wh": (h, 3 * h), "b": (3 * h,), "cw": (h, self.classes), "cb": (self.classes,), "uw": (h, self.classes * self.width), "ub": (self.classes * self.width,)}


@functools.cache
def _places(shape: Shape) -> list[tuple[str, int, int, tuple[int, ...]]]:
    """(name, start, end, form) of the parts of a weight vector, and of each output's weights with its biases as one more row."""
    out, at = [], 0
    for name, form in shape.parts().items():
        out.append((name, at, at + math.prod(form), form))
        at += math.prod(form)
    of = {name: (start, end) for name, start, end, _ in out}
    return out + [(name, of[w][0], of[b][1], (shape.hidden + 1, -1)) for name, w, b in (("classes", "cw", "cb"), ("inside", "uw", "ub"))]


def split(vector: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    """Views of a flat weight vector."""
    return {name: vector[start:end].reshape(form) for name, start, end, form in _places(shape)}


def initial(shape: Shape, mass: np.ndarray, seed: int = 1) -> np.ndarray:
    """Weights whose output is the share of each unit's mass, whatever the state."""
    rng = np.random.default_rng(seed)
    vector = np.zeros(sum(math.prod(d) for d in shape.parts().values()), FLOAT)
    p = split(vector, shape)
    for name, scale in (("embed", 0.3), ("wx", 0.3), ("wh", 0.15)):
        p[name][:] = rng.normal(0, scale, p[name].shape)
    share = np.zeros(shape.classes * shape.width)
    share[: shape.units] = mass / mass.sum()
    of_class = share.reshape(shape.classes, shape.width).sum(1)
    p["cb"][:] = np.log(of_class)
    inside = share.reshape(shape.classes, -1) / of_class[:, None]
    p["ub"][:] = np.where(inside > 0, np.log(np.maximum(inside, 1e-30)), -1e9).ravel()
    return vector


def _exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exp of x less a shift, the sums over columns, the shift). x goes down the columns and is overwritten."""
    shift = FLOAT(0)
    if x.max(initial=0) > 60:
        shift = x.max(axis=0)
        x -= shift
    np.exp(x, out=x)
    return x, x.sum(axis=0), shift


def _log_sums(x: np.ndarray) -> np.ndarray:
    """Log of the sum of exp over each column; x is overwritten."""
    _, total, shift = _exponentials(x)
    return np.log(total) + shift


def _by_class(targets: np.ndarray, width: int) -> tuple[np.ndarray, list[tuple[int, slice, np.ndarray]]]:
    """The order that puts targets of a class side by side, and (class, where, slots) of each class in it."""
    classes = targets // width
    # numpy sorts 16 bits by their digits.
    order = np.argsort(classes.astype(np.uint16) if classes.max(initial=0) < 1 << 16 else classes, kind="stable")
    held, slots = classes[order], (targets - classes * width)[order]
    edges = [0, *(np.flatnonzero(held[1:] != held[:-1]) + 1).tolist(), len(held)]
    return order, [(int(held[a]), slice(a, b), slots[a:b]) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def log_probabilities(p: dict[str, np.ndarray], shape: Shape, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log of each target's probability after its state."""
    w, n = shape.width, np.arange(len(targets))
    order, classes = _by_class(targets, w)
    down, held = _columns_and_one(states.T, order), targets[order] // w
    x = p["classes"].T @ down
    got = x[held, n]
    got -= _log_sums(x)
    for c, at, slots in classes:
        x = p["inside"][:, c * w : (c + 1) * w].T @ down[:, at]
        own = x[slots, n[: len(slots)]]
        own -= _log_sums(x)
        got[at] += own
    out = np.empty_like(got)
    out[order] = got
    return out


def _room(rows: int, columns: int, kind: np.dtype) -> np.ndarray:
    """An unfilled matrix whose rows are no multiple of 4 KB apart: they would share the same few lines of the cache."""
    return np.empty((rows, columns + (384 - columns) % 1024), kind)[:, :columns]


def _take(x: np.ndarray, which: np.ndarray, out: np.ndarray) -> None:
    """Puts the columns of x that which names into out, row by row."""
    for row, to in zip(x, out, strict=True):
        row.take(which, mode="clip", out=to)


def _columns_and_one(x: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The columns of x, each with a one at its end that biases are multiplied by."""
    out = _room(len(x) + 1, len(which), x.dtype)
    _take(x, which, out[:-1])
    out[-1] = 1
    return out


def _joined(p: dict[str, np.ndarray], n: int) -> np.ndarray:
    """One matrix for a step: rows for the state, the embedding and a one; columns for the candidate's input,
    the negated update and reset gates and the candidate's recurrent part."""
    wx = np.vstack((p["wx"], p["b"]))
    out = np.zeros((n + len(wx), 4 * n), wx.dtype)
    out[n:, :n] = wx[:, 2 * n :]
    np.negative(p["wh"][:, : 2 * n], out=out[:n, n : 3 * n])
    np.negative(wx[:, : 2 * n], out=out[n:, n : 3 * n])
    out[:n, 3 * n :] = p["wh"][:, 2 * n :]
    return out


def _cell(sums: np.ndarray, h: np.ndarray, gates: np.ndarray, candidate: np.ndarray, less: np.ndarray, new: np.ndarray) -> None:
    """Fills gates, candidate, the state less the candidate, and the new state, from a step's sums."""
    n = len(h)
    np.exp(sums[n : 3 * n], out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    np.multiply(gates[n:], sums[3 * n :], out=candidate)
    candidate += sums[:n]
    np.tanh(candidate, out=candidate)
    np.subtract(h, candidate, out=less)
    np.multiply(less, gates[:n], out=new)
    new += candidate


def _columns(x: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The columns of x that which names; clip only saves numpy a buffer, as each is one of x."""
    return x.take(which, axis=1, mode="clip")


def _gates(p: dict[str, np.ndarray]) -> np.ndarray:
    """What each unit adds to the gates, the same wherever it stands: a column for each unit."""
    return np.ascontiguousarray((p["embed"] @ p["wx"] + p["b"]).T)


def _step(gates_in: np.ndarray, h: np.ndarray, wh: np.ndarray, n: int):
    """(next state, update gate, reset gate, candidate, recurrent part of the candidate)."""
    own = (wh.T @ h.T).T
    gates = own[:, : 2 * n] + gates_in[:, : 2 * n]
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    z, r = gates[:, :n], gates[:, n:]
    candidate = r * own[:, 2 * n :]
    candidate += gates_in[:, 2 * n :]
    np.tanh(candidate, out=candidate)
    new = h - candidate
    new *= z
    new += candidate
    return new, z, r, candidate, own[:, 2 * n :]


class Streams:
    """Documents laid end to end in parallel streams, the longest stream first."""

    def __init__(self, docs: list[np.ndarray], end: int, least: int, most: int):
        sizes = np.array([len(d) for d in docs])
        count = int(np.clip(sizes.sum() // max(1, sizes.max(initial=1)), least, most))
        loads = [(0, i) for i in range(min(count, len(docs)))]
        members: list[list[int]] = [[] for _ in loads]
        for d in np.argsort(-sizes, kind="stable").tolist():
            load, i = heapq.heappop(loads)
            members[i].append(d)
            heapq.heappush(loads, (load + int(sizes[d]), i))
        members.sort(key=lambda m: -int(sizes[m].sum()))
        order = [d for m in members for d in m]
        self.length = np.array([int(sizes[m].sum()) for m in members], np.int64)
        self.offset = np.cumsum(self.length) - self.length
        laid, sizes = [docs[d] for d in order], sizes[order]
        self.target = np.concatenate(laid).astype(np.int32)
        self.doc = np.repeat(np.array(order, np.int32), sizes)
        self.start = np.zeros(len(self.target), bool)
        self.start[np.cumsum(sizes) - sizes] = True
        self.given = np.empty_like(self.target)
        self.given[1:] = self.target[:-1]
        self.given[self.start] = end

    def windows(self, steps: int):
        """(targets, inputs, starts of documents, document numbers), each steps x active streams, with the active streams at each step."""
        for at in range(0, int(self.length.max(initial=0)), steps):
            active = int((self.length > at).sum())
            n = min(steps, int(self.length[0]) - at)
            place = at + np.arange(n)[:, None]
            inside = place < self.length[None, :active]
            flat = np.where(inside, self.offset[None, :active] + place, 0)
            yield self.target[flat], self.given[flat], self.start[flat] & inside, self.doc[flat], inside.sum(1)


def score(vector: np.ndarray, shape: Shape, docs: list[np.ndarray], end: int, steps: int = 48) -> np.ndarray:
    """The natural log of each whole document's probability."""
    total = np.zeros(len(docs))
    if not docs:
        return total
    p = split(vector, shape)
    table = _gates(p)
    h = None
    for target, given, start, doc, live in Streams(docs, end, 32, 512).windows(steps):
        h = np.zeros((shape.hidden, target.shape[1]), FLOAT).T if h is None else h[: target.shape[1]]
        goes_on = ~start[:, :, None]
        states = np.empty((shape.hidden, int(live.sum())), FLOAT).T
        at = 0
        for t, a in enumerate(live.tolist()):
            h = _step(_columns(table, given[t, :a]).T, h[:a] * goes_on[t, :a], p["wh"], shape.hidden)[0]
            states[at : at + a] = h
            at += a
        inside = np.arange(target.shape[1]) < live[:, None]
        got = log_probabilities(p, shape, states, target[inside])
        total += np.bincount(doc[inside], got.astype(np.float64), len(docs))
    return total


class Adam:
    #: Weights at a time: all that belongs to them stays in the cache.
    BLOCK = 8192

    def __init__(self, size: int, rate: float):
        # Sums of gradients and of their squares that fade by 0.9 and 0.99: ten and a hundred times the means.
        self.m, self.v, self.t, self.rate = np.zeros(size, FLOAT), np.zeros(size, FLOAT), 0, rate

    def update(self, vector: np.ndarray, grad: np.ndarray) -> None:
        """Moves vector; grad is overwritten."""
        self.t += 1
        rate = FLOAT(self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))
        for at in range(0, len(vector), self.BLOCK):
            m, v, to, step = (x[at : at + self.BLOCK] for x in (self.m, self.v, vector, grad))
            m *= FLOAT(0.9)
            m += step
            step *= step
            v *= FLOAT(0.99)
            v += step
            np.sqrt(v, out=step)
            step += FLOAT(1e-5)
            np.divide(m, step, out=step)
            step *= rate
            to -= step


def _errors(x: np.ndarray, chosen: np.ndarray, w: np.ndarray, with_loss: bool) -> float:
    """Makes each column of x the probabilities it stands for, less one at the chosen row, times w. The sum of the
    chosen rows' weighted logs, or 0 without loss."""
    rows = np.arange(len(chosen))
    own = x[chosen, rows] if with_loss else None
    x, total, shift = _exponentials(x)
    x *= w / total
    x[chosen, rows] -= w
    return ((own - np.log(total) - shift) * w).sum() if with_loss else 0.0


def gradient(vector: np.ndarray, shape: Shape, h0: np.ndarray, target: np.ndarray, given: np.ndarray, start: np.ndarray, live: np.ndarray, with_loss: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss a token, or 0 without loss, gradient, last state) of one window; nothing flows into the window before it."""
    p, n, e = split(vector, shape), shape.hidden, shape.embedding
    steps, b = target.shape
    grad = np.zeros_like(vector)
    g = split(grad, shape)
    weight = (np.arange(b)[None, :] < live[:, None]).astype(FLOAT)
    goes_on = (~start).astype(FLOAT)
    joined, flat_given = _joined(p, n), given.ravel()
    # What a step's sums are made of: state before it, embedding, one.
    flat_x, flat_states = _room(n + e + 1, steps * b, FLOAT), _room(n, steps * b, FLOAT)
    x, states, gates = flat_x.reshape(-1, steps, b), flat_states.reshape(n, steps, b), np.empty((steps, 2 * n, b), FLOAT)
    _take(np.ascontiguousarray(p["embed"].T), flat_given, flat_x[n:-1])
    x[-1] = 1
    # By how much the gates' sums and the candidate's move with the new state; the reset gate's with the candidate's.
    by_gates, by_candidate = np.empty_like(gates), np.empty((steps, n, b), FLOAT)
    sums, less, rest = np.empty((4 * n, b), FLOAT), np.empty((n, b), FLOAT), np.empty((2 * n, b), FLOAT)
    last = h0.T
    for t in range(steps):
        h = np.multiply(last, goes_on[t], out=x[:n, t])
        last = states[:, t]
        np.matmul(joined.T, x[:, t], out=sums)
        _cell(sums, h, gates[t], by_candidate[t], less, last)
        np.subtract(gates[t], 1, out=rest)
        np.multiply(gates[t], rest, out=by_gates[t])
        by_gates[t, :n] *= less
        by_gates[t, n:] *= sums[3 * n :]
        by_candidate[t] *= by_candidate[t]
        by_candidate[t] -= 1
        by_candidate[t] *= rest[:n]
    flat = target.ravel()
    w = weight.ravel() / max(float(weight.sum()), 1.0)
    # Tokens of a class stand side by side from here on.
    order, classes = _by_class(flat, shape.width)
    held, w = flat[order], w[order]
    down, width, loss = _columns_and_one(flat_states, order), shape.width, 0.0
    of_classes, inside = _room(shape.classes, len(flat), FLOAT), _room(width, len(flat), FLOAT)
    np.matmul(p["classes"].T, down, out=of_classes)
    for c, at, _ in classes:
        np.matmul(p["inside"][:, c * width : (c + 1) * width].T, down[:, at], out=inside[:, at])
    for d, chosen in ((of_classes, held // width), (inside, held % width)):
        loss -= _errors(d, chosen, w, with_loss)
    np.matmul(down, of_classes.T, out=g["classes"])
    up = np.matmul(p["cw"], of_classes, out=_room(n, len(flat), FLOAT))
    for c, at, _ in classes:
        part = slice(c * width, (c + 1) * width)
        np.matmul(down[:, at], inside[:, at].T, out=g["inside"][:, part])
        up[:, at] += p["uw"][:, part] @ inside[:, at]
    back = np.empty_like(order)
    back[order] = np.arange(len(flat))
    flat_dh, flat_dsums = _room(n, len(flat), FLOAT), _room(4 * n, len(flat), FLOAT)
    _take(up, back, flat_dh)
    dh, dsums, carried = flat_dh.reshape(n, steps, b), flat_dsums.reshape(-1, steps, b), np.zeros((n, b), FLOAT)
    of_state = joined[:n, n:]
    for t in range(steps - 1, -1, -1):
        up, own = dh[:, t], dsums[:, t]
        up += carried
        dc = np.multiply(up, by_candidate[t], out=own[:n])
        np.multiply(up, by_gates[t, :n], out=own[n : 2 * n])
        np.multiply(dc, by_gates[t, n:], out=own[2 * n : 3 * n])
        # The candidate's recurrent part goes through the reset gate, its other part doesn't.
        np.multiply(dc, gates[t, n:], out=own[3 * n :])
        np.matmul(of_state, own[n:], out=carried)
        up *= gates[t, :n]
        carried += up
        carried *= goes_on[t]
    from_state, from_input = flat_x[:n] @ flat_dsums[n:].T, flat_x[n:] @ flat_dsums[: 3 * n].T
    np.negative(from_state[:, : 2 * n], out=g["wh"][:, : 2 * n])
    g["wh"][:, 2 * n :] = from_state[:, 2 * n :]
    for name, own in (("wx", from_input[:-1]), ("b", from_input[-1])):
        np.negative(own[..., n:], out=g[name][..., : 2 * n])
        g[name][..., 2 * n :] = own[..., :n]
    for i, through in enumerate(joined[n:-1, : 3 * n] @ flat_dsums[: 3 * n]):
        g["embed"][:, i] = np.bincount(flat_given, through, shape.units)
    return float(loss), grad, states[:, -1].T


def train(vector: np.ndarray, shape: Shape, docs: list[np.ndarray], end: int, adam: Adam | None = None, steps: int = 16, streams: int | None = None, clip: float = 1.0, rate: float = RATE) -> np.ndarray:
    """The weights after one pass over docs."""
    vector = vector.copy()
    if not docs:
        return vector
    adam = adam or Adam(len(vector), rate)
    # All documents end to end, cut into equal streams: none waits for the longest document.
    target, given = np.concatenate(docs).astype(np.int64), np.empty(sum(map(len, docs)), np.int64)
    start = np.zeros(len(target), bool)
    start[np.cumsum([0, *map(len, docs[:-1])])] = True
    given[1:] = target[:-1]
    given[start] = end
    streams = min(streams or int(np.clip(len(target) // STREAM_TOKENS, FEW_STREAMS, STREAMS)), len(target))
    long = -(-len(target) // streams)
    lanes = lambda x: np.resize(x, streams * long).reshape(streams, long).T
    target, given, start = (np.ascontiguousarray(lanes(x)) for x in (target, given, start))
    h = np.zeros((streams, shape.hidden), FLOAT)
    for at in range(0, long, steps):
        part = slice(at, at + steps)
        live = np.full(len(target[part]), streams)
        _, grad, h = gradient(vector, shape, h, target[part], given[part], start[part], live, with_loss=False)
        norm = float(np.sqrt(grad @ grad))
        if norm > clip:
            grad *= FLOAT(clip / norm)
        adam.update(vector, grad)
    return vector
