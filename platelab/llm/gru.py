"""A gated recurrent language model in numpy with a class-factored softmax.

Tokens fall into classes. A class of head words has a softmax over its words; a class of rare words has fixed
probabilities within it, so the network predicts the class only. Documents run in lanes next to each other; a lane
that ends one document starts the next with a blank state. Lanes are ordered by length, so at every step the lanes
that are still running come first and nothing is padded. Head words are taken class by class.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

#: Units of the state, and numbers that stand for an input token.
HIDDEN, EMBEDDED = 16, 16
WINDOW = 16
#: Bounds of the number of lanes; between them, a batch has so many that it makes about ``UPDATES`` windows.
LANES = 32, 512
UPDATES = 48
#: Logits are cut here in training, where sums of their powers need not be scaled.
MOST = np.float32(70)
#: Rows whose logits are worked on at one time, so that they stay in the processor's cache.
PART = 1024

Params = dict[str, np.ndarray]


def sizes(inputs: int, classes: int, heads: int, words: int) -> dict[str, tuple[int, ...]]:
    return {
        "inputs": (inputs, EMBEDDED),
        "given_gates": (EMBEDDED, 2 * HIDDEN),
        "given_new": (EMBEDDED, HIDDEN),
        "turn_gates": (HIDDEN, 2 * HIDDEN),
        "turn_new": (HIDDEN, HIDDEN),
        "classes": (HIDDEN + 1, classes),  # the last row of either is for the constant that goes with each state
        "words": (heads, HIDDEN + 1, words),
    }


def views(flat: np.ndarray, shapes: dict[str, tuple[int, ...]]) -> Params:
    """The parameters as views of one vector."""
    out, at = {}, 0
    for name, shape in shapes.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def new_params(shapes: dict[str, tuple[int, ...]], class_share: np.ndarray, word_share: np.ndarray, seed: int = 11) -> np.ndarray:
    """Small random weights; last rows give the shares, so that an untrained model is about a unigram model."""
    flat = (np.random.default_rng(seed).standard_normal(sum(int(np.prod(s)) for s in shapes.values())) * 0.1).astype(np.float32)
    params = views(flat, shapes)
    for name, size in (("given_gates", 3), ("given_new", 3), ("turn_gates", 2), ("turn_new", 2), ("words", 0.1)):
        params[name] *= np.float32(size)
    params["inputs"][:, 0] = 1  # a bias for all inputs
    params["classes"][-1] = np.log(class_share)
    params["words"][:, -1] = np.log(word_share)
    return flat


class Lanes:
    """Where each token of each document stands when documents of these lengths run in lanes, step by step."""

    def __init__(self, lengths: np.ndarray, lanes: int | None = None):
        if lanes is None:
            lanes = max(LANES[0], min(LANES[1], int(lengths.sum()) // max(UPDATES * WINDOW, int(lengths.max(initial=1)))))
        lanes = max(1, min(lanes, len(lengths)))
        loads = [(0, i) for i in range(lanes)]
        lane = np.empty(len(lengths), np.int64)
        start = np.empty(len(lengths), np.int64)
        for doc in np.argsort(-lengths, kind="stable").tolist():
            load, i = heapq.heappop(loads)
            lane[doc], start[doc] = i, load
            heapq.heappush(loads, (load + int(lengths[doc]), i))
        total = np.zeros(lanes, np.int64)
        for load, i in loads:
            total[i] = load
        by_length = np.argsort(-total, kind="stable")
        place = np.empty(lanes, np.int64)
        place[by_length] = np.arange(lanes)
        steps = int(total.max())
        self.active = lanes - np.searchsorted(np.sort(total), np.arange(steps), "right")
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        self.steps, self.lanes = steps, lanes
        doc = np.repeat(np.arange(len(lengths)), lengths)
        inside = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        where = self.at[start[doc] + inside] + place[lane[doc]]
        self.order = np.empty(len(doc), np.int32)
        self.order[where] = np.arange(len(doc), dtype=np.int32)

    def windows(self, size: int) -> Iterator[tuple[int, int]]:
        for top in range(0, self.steps, size):
            yield top, min(self.steps, top + size)


class Work:
    """Arrays that every window uses again, as fresh memory costs more than the sums done in it."""

    def __init__(self, rows: int, dtype: type = np.float32):
        self.rows, self.dtype, self.held = rows, dtype, {}

    def __call__(self, name: str, rows: int, width: int) -> np.ndarray:
        if name not in self.held:
            self.held[name] = np.empty((self.rows, width), self.dtype)
        return self.held[name][:rows]

    def step(self, name: str, width: int, top: int, end: int) -> np.ndarray:
        """What a step's tokens ``top`` to ``end`` have: a row for each number, so that whole rows are worked on."""
        if name not in self.held:
            self.held[name] = np.empty(self.rows * width, self.dtype)
        return self.held[name][width * top : width * end].reshape(width, -1)


def _joint(params: Params) -> np.ndarray:
    """One matrix from a state and an input to the gates, the turned state and what the input gives to the candidate."""
    out = np.zeros((4 * HIDDEN, HIDDEN + EMBEDDED), params["turn_gates"].dtype)
    out[: 2 * HIDDEN, :HIDDEN], out[: 2 * HIDDEN, HIDDEN:] = params["turn_gates"].T, params["given_gates"].T
    out[2 * HIDDEN : 3 * HIDDEN, :HIDDEN], out[3 * HIDDEN :, HIDDEN:] = params["turn_new"].T, params["given_new"].T
    return out


def run(params: Params, work: Work, lanes: Lanes, top: int, end: int, inputs: np.ndarray, keep: np.ndarray, state: np.ndarray) -> np.ndarray:
    """States after each token of steps ``top`` to ``end``, each with a 1 behind; ``state`` is carried on in place.

    ``work`` keeps what the way back needs, step by step: ``both``, the state before and the input; ``made``, the gates
    (update, reset), the candidate's share of the state and the candidate. Gates are 1 / (1 + exp(x)).
    """
    joint, carried = _joint(params), state.T
    embedded = np.take(params["inputs"], inputs, axis=0, out=work("embedded", len(inputs), EMBEDDED), mode="clip")
    out = work("with_one", len(inputs), HIDDEN + 1)
    out[:, HIDDEN] = 1
    cuts = (lanes.at[top : end + 1] - lanes.at[top]).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        now = carried[:, : b - a]
        x = work.step("both", HIDDEN + EMBEDDED, a, b)
        h = np.multiply(now, keep[a:b], out=x[:HIDDEN])
        x[HIDDEN:] = embedded[a:b].T
        y = np.matmul(joint, x, out=work.step("made", 4 * HIDDEN, a, b))
        gates, new = y[: 2 * HIDDEN], y[3 * HIDDEN :]
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        after = np.multiply(gates[HIDDEN:], y[2 * HIDDEN : 3 * HIDDEN], out=work.step("after", HIDDEN, 0, b - a))
        new += after
        np.tanh(new, out=new)
        np.subtract(h, new, out=after)
        after *= gates[:HIDDEN]
        after += new
        now[:] = after
        out[a:b, :HIDDEN] = after.T
    return out


def _by_class(classes: np.ndarray, heads: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Rows of head words in the order of their classes, and each class that occurs with its part of them."""
    rows = np.flatnonzero((classes >= 0) & (classes < heads))
    of = classes[rows].astype(np.int16)
    ends = np.cumsum(np.bincount(of, minlength=heads)).tolist()
    parts = [(c, a, b) for c, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if a < b]
    return rows[np.argsort(of, kind="stable")], parts


def _grouped(parts: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Classes to be worked on at one time, of about ``PART`` rows."""
    held: list[tuple[int, int, int]] = []
    for part in parts:
        if held and part[2] - held[0][1] > PART:
            yield held
            held = []
        held.append(part)
    if held:
        yield held


def _log_sum(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of each row's powers, for logits of any size; both arrays are used up."""
    ones = np.ones(x.shape[1], x.dtype)
    with np.errstate(over="ignore", invalid="ignore"):
        total = np.exp(x, out=spare) @ ones
    if x.size and not 0 < total.min() <= total.max() < np.inf:  # powers too large or too small
        most = x.max(axis=1)
        x -= most[:, None]
        return np.log(np.exp(x, out=x) @ ones) + most
    return np.log(total)


def _classes(params: Params, work: Work, given: np.ndarray) -> np.ndarray:
    """Logits of the classes."""
    return np.matmul(given, params["classes"], out=work("classes", len(given), params["classes"].shape[1]))


def _inside(params: Params, work: Work, given: np.ndarray, parts: list[tuple[int, int, int]]) -> np.ndarray:
    """Logits of the words of each row's class."""
    out = work("words", len(given), params["words"].shape[2])
    for c, a, b in parts:
        np.matmul(given[a:b], params["words"][c], out=out[a:b])
    return out


def log_probabilities(params: Params, work: Work, given: np.ndarray, classes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each token's class and, for head words, of the word in its class, ``given`` what ``run`` returns."""
    out = np.empty(len(given))
    for k in range(0, len(given), PART):
        part = slice(k, k + PART)
        x = _classes(params, work, given[part])
        out[part] = x[np.arange(len(x)), classes[part]]
        out[part] -= _log_sum(x, work("powers", *x.shape))
    rows, parts = _by_class(classes, len(params["words"]))
    own = np.take(given, rows, axis=0, out=work("own", len(rows), HIDDEN + 1), mode="clip")
    for some in _grouped(parts):
        top, end = some[0][1], some[-1][2]
        at = rows[top:end]
        y = _inside(params, work, own[top:end], [(c, a - top, b - top) for c, a, b in some])
        out[at] += y[np.arange(len(at)), words[at]] - _log_sum(y, work("powers_inside", *y.shape))
    return out


def _surprise(logits: np.ndarray, target: np.ndarray, large: bool) -> tuple[float, np.ndarray]:
    """The negative log-likelihood of the targets, and a factor for each row by which its logits, changed in place, are
    what the loss changes by with each of them; what they are multiplied with is narrower, and so the cheaper to scale."""
    every = np.arange(len(logits))
    if large:
        np.minimum(logits, MOST, out=logits)
    loss = -float(logits[every, target].sum())
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    logits[every, target] -= total
    return loss + float(np.log(total).sum()), (1 / total)[:, None]


def gradients(params: Params, grads: Params, work: Work, lanes: Lanes, top: int, end: int, inputs: np.ndarray, keep: np.ndarray, classes: np.ndarray, words: np.ndarray, state: np.ndarray) -> float:
    """Add the gradients of a window's negative log-likelihood, going back no further than its start; returns that sum.

    Tokens of class -1 only move the state.
    """
    n = len(inputs)
    given = run(params, work, lanes, top, end, inputs, keep, state)
    back = work("back", n, HIDDEN)
    live = np.flatnonzero(classes >= 0)
    counted, by_class, targets = (given, back, classes) if len(live) == n else (given[live], work("by_class", len(live), HIDDEN), classes[live])
    # states lie between -1 and 1, so that this bounds the logits
    large = max(np.abs(params["classes"]).sum(axis=0).max(), np.abs(params["words"]).sum(axis=1).max()) > MOST
    to_states = np.ascontiguousarray(params["classes"][:HIDDEN].T)
    loss = 0.0
    for k in range(0, len(live), PART):
        part = slice(k, min(len(live), k + PART))
        p = _classes(params, work, counted[part])
        lost, scale = _surprise(p, targets[part], large)
        loss += lost
        grads["classes"] += (counted[part] * scale).T @ p
        np.matmul(p, to_states, out=by_class[part])
        by_class[part] *= scale
    if len(live) < n:
        back.fill(0)
        back[live] = by_class
    rows, parts = _by_class(classes, len(params["words"]))
    own = np.take(given, rows, axis=0, out=work("own", len(rows), HIDDEN + 1), mode="clip")
    by_own = work("by_own", len(rows), HIDDEN)
    for some in _grouped(parts):
        top_row, end_row = some[0][1], some[-1][2]
        mine = own[top_row:end_row]
        some = [(c, a - top_row, b - top_row) for c, a, b in some]
        q = _inside(params, work, mine, some)
        lost, scale = _surprise(q, words[rows[top_row:end_row]], large)
        loss += lost
        mine *= scale
        by_mine = by_own[top_row:end_row]
        for c, a, b in some:
            grads["words"][c] += mine[a:b].T @ q[a:b]
            np.matmul(q[a:b], params["words"][c, :HIDDEN].T, out=by_mine[a:b])
        by_mine *= scale
    back[rows] += by_own
    to_both = np.ascontiguousarray(_joint(params).T)
    total = np.zeros((4 * HIDDEN, HIDDEN + EMBEDDED), back.dtype)
    by_input, places = grads["inputs"].reshape(-1), np.arange(EMBEDDED)[:, None]
    cuts = (lanes.at[top : end + 1] - lanes.at[top]).tolist()
    carry = np.zeros((HIDDEN, 0), back.dtype)
    for a, b in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
        x, y = work.step("both", HIDDEN + EMBEDDED, a, b), work.step("made", 4 * HIDDEN, a, b)
        z, r, turned, new = (y[k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        dh, changed = work.step("dh", HIDDEN, 0, b - a), work.step("changed", 4 * HIDDEN, 0, b - a)
        dz, dr, dt, dn = (changed[k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        dh[:] = back[a:b].T
        dh[:, : carry.shape[1]] += carry
        spare = np.subtract(1, z, out=dr)
        np.multiply(dh, spare, out=dn)
        np.subtract(new, x[:HIDDEN], out=dz)  # the gates fall as what they are made of grows
        dz *= z
        dz *= spare
        dz *= dh
        np.multiply(new, new, out=spare)
        np.subtract(1, spare, out=spare)
        dn *= spare
        np.multiply(dn, r, out=dt)
        np.subtract(r, 1, out=dr)
        dr *= turned
        dr *= dt
        total += changed @ x.T
        by_both = to_both @ changed
        np.add.at(by_input, (inputs[a:b].astype(np.int64) * EMBEDDED + places).ravel(), by_both[HIDDEN:].ravel())
        carry = by_both[:HIDDEN]
        dh *= z
        carry += dh
        carry *= keep[a:b]
    grads["turn_gates"] += total[: 2 * HIDDEN, :HIDDEN].T
    grads["given_gates"] += total[: 2 * HIDDEN, HIDDEN:].T
    grads["turn_new"] += total[2 * HIDDEN : 3 * HIDDEN, :HIDDEN].T
    grads["given_new"] += total[3 * HIDDEN :, HIDDEN:].T
    return loss


class Adam:
    """Adaptive steps for one worker's share of the tokens; gradients gather in ``grads`` until there are enough of them."""

    def __init__(self, flat: np.ndarray, shapes: dict[str, tuple[int, ...]], rate: float):
        self.flat, self.rate, self.t, self.tokens = flat, rate, 0, 0
        self.sum, self.mean, self.square, self.spare = (np.zeros_like(flat) for _ in range(4))
        self.grads = views(self.sum, shapes)

    def step(self) -> None:
        if not self.tokens:
            return
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        g, spare = self.sum, self.spare
        g /= self.tokens
        self.mean *= 0.9
        self.mean += np.multiply(g, 0.1, out=spare)
        self.square *= 0.99
        np.multiply(g, g, out=spare)
        spare *= 0.01
        self.square += spare
        np.sqrt(self.square, out=spare)
        spare += 1e-7
        np.divide(self.mean, spare, out=spare)
        spare *= np.float32(rate)
        self.flat -= spare
        g.fill(0)
        self.tokens = 0


def train(params: Params, adam: Adam, lanes: Lanes, inputs: np.ndarray, keep: np.ndarray, classes: np.ndarray, words: np.ndarray) -> float:
    """One pass over tokens in lane order; states carry over from window to window. Returns the negative log-likelihood."""
    state = np.zeros((HIDDEN, lanes.lanes), np.float32).T
    work = Work(lanes.lanes * WINDOW)
    loss = 0.0
    for top, end in lanes.windows(WINDOW):
        s = slice(lanes.at[top], lanes.at[end])
        loss += gradients(params, adam.grads, work, lanes, top, end, inputs[s], keep[s], classes[s], words[s], state)
        adam.tokens += int(np.count_nonzero(classes[s] >= 0))
        if 2 * adam.tokens >= work.rows:
            adam.step()
    adam.step()
    return loss


def score(params: Params, lanes: Lanes, inputs: np.ndarray, keep: np.ndarray, classes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """``log_probabilities`` of all tokens in lane order, the states carried through whole documents."""
    state = np.zeros((HIDDEN, lanes.lanes), np.float32).T
    work = Work(lanes.lanes * WINDOW)
    out = np.empty(len(inputs))
    for top, end in lanes.windows(WINDOW):
        s = slice(lanes.at[top], lanes.at[end])
        out[s] = log_probabilities(params, work, run(params, work, lanes, top, end, inputs[s], keep[s], state), classes[s], words[s])
    return out
