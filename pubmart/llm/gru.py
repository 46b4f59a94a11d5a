"""A gated recurrent language model in numpy: scoring and truncated backpropagation.

The output softmax is factored by classes. Head words lie in HEAD_CLASSES classes of CLASS_SIZE
words, each with its own softmax; every tail class holds the words of one suffix code, shared out
by their counts, so that any word has a probability. A tail word is read by its class.
"""

from __future__ import annotations

import math

import numpy as np

HEAD_CLASSES = 32
CLASS_SIZE = 32
HEAD = HEAD_CLASSES * CLASS_SIZE
TAILS = 48
CLASSES = HEAD_CLASSES + TAILS
UNITS = 32
#: Inputs: head words, tail classes, and the start of a text.
INPUTS = HEAD + TAILS + 1
START = HEAD + TAILS
WINDOW = 16
#: Streams learnt side by side, each of so many tokens at least.
STREAMS = 256
STREAM_TOKENS = 1024
SEGMENT = 1024
RATE = 0.02
CLIP = 5.0
#: Scores below this need no shift before their exponentials (float32 takes 88).
MOST_SCORE = 60.0
SEED = 5

SHAPES = {
    "read": (INPUTS, 3 * UNITS),
    "again": (UNITS, 3 * UNITS),
    "bias": (3 * UNITS,),
    "to_class": (UNITS, CLASSES),
    "class_bias": (CLASSES,),
    "to_word": (HEAD_CLASSES, UNITS, CLASS_SIZE),
    "word_bias": (HEAD_CLASSES, CLASS_SIZE),
}
Weights = dict[str, np.ndarray]


def started(head_counts: np.ndarray, tail_counts: np.ndarray) -> Weights:
    """Weights whose first predictions are the counts' shares."""
    rng = np.random.default_rng(SEED)
    out = {k: np.zeros(s, dtype=np.float32) for k, s in SHAPES.items()}
    out["read"] = rng.normal(0, 0.3, SHAPES["read"]).astype(np.float32)
    out["again"] = rng.normal(0, UNITS**-0.5, SHAPES["again"]).astype(np.float32)
    words = head_counts.reshape(HEAD_CLASSES, CLASS_SIZE)
    # slots without a word stay (nearly) impossible
    out["word_bias"] = np.where(words > 0, np.log(np.maximum(words, 1e-9)), -30).astype(np.float32)
    shares = np.concatenate([words.sum(axis=1), tail_counts])
    out["class_bias"] = np.log(np.maximum(shares, 1e-9) / max(shares.sum(), 1e-9)).clip(-30).astype(np.float32)
    return out


class Room:
    """Arrays by name that are filled anew in each window, so that memory is not asked for and given back each time."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, dtype: np.dtype, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        found = self.held.get(name)
        if found is None or found.size < size or found.dtype != dtype:
            found = self.held[name] = np.empty(size, dtype=dtype)
        return found[:size].reshape(shape)


def _taken(rows: np.ndarray, at: np.ndarray, out: np.ndarray, axis: int = 0) -> np.ndarray:
    return np.take(rows, at, axis=axis, out=out, mode="clip")  # all places are valid; "raise" would copy the output


def _by_gate(rows: np.ndarray) -> np.ndarray:
    """The update, reset and fresh part of rows, one behind the other; the first two negated for ``_step``."""
    out = np.ascontiguousarray(rows.reshape(len(rows), 3, UNITS).transpose(1, 0, 2))
    np.negative(out[:2], out=out[:2])
    return out


def _step(again: np.ndarray, x: np.ndarray, h: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Update and reset gate, recurrent part, fresh part and state behind inputs x.

    ``again`` and ``x`` (which is overwritten) lie gate by gate (``_by_gate``), so that all passes are over
    whole blocks of memory.
    """
    g = np.matmul(h, again)
    both, fresh = x[:2], x[2]
    both += g[:2]
    with np.errstate(over="ignore"):  # of a gate that is shut
        np.exp(both, out=both)
    both += 1
    np.divide(1, both, out=both)
    fresh += both[1] * g[2]
    np.tanh(fresh, out=fresh)
    state = np.subtract(h, fresh, out=state)
    state *= both[0]
    state += fresh
    return both[0], both[1], g[2], fresh, state


def _gates(again: np.ndarray, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gates, and the state behind inputs x: rows of ``read`` with the bias."""
    return _step(_by_gate(again), _by_gate(x), h)


def _tame(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no score of a state (its parts lie between -1 and 1) is near what a float32 exponential can take."""
    return bool((np.abs(weights).sum(axis=-2) + np.abs(bias)).max() < MOST_SCORE)


def _powers(scores: np.ndarray, tame: bool, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of scores, in place, up to a factor for each row; the row's total and its score at ``at``."""
    if not tame:
        scores -= scores.max(axis=1, keepdims=True)
    picked = scores[np.arange(len(scores)), at]
    np.exp(scores, out=scores)
    return picked, scores @ np.ones(scores.shape[1], dtype=scores.dtype)


def _kinds(target: np.ndarray) -> np.ndarray:
    return np.where(target >= HEAD, target - HEAD + HEAD_CLASSES, target // CLASS_SIZE).astype(np.int16)


def _by_class(kind: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Places of head words, class by class, and (class, begin, end) of the classes that occur."""
    ends = np.cumsum(np.bincount(kind, minlength=CLASSES)[:HEAD_CLASSES]).tolist()
    some = [(c, a, b) for c, (a, b) in enumerate(zip([0, *ends], ends)) if b > a]
    return np.argsort(kind, kind="stable")[: ends[-1]], some


def _word_scores(w: Weights, states: np.ndarray, some: list[tuple[int, int, int]], out: np.ndarray | None = None) -> np.ndarray:
    """Scores inside the class of each state; states lie class by class."""
    if out is None:
        out = np.empty((len(states), CLASS_SIZE), dtype=np.result_type(states, w["to_word"]))
    for c, a, b in some:
        np.matmul(states[a:b], w["to_word"][c], out=out[a:b])
        out[a:b] += w["word_bias"][c]
    return out


def _log_chances(w: Weights, h: np.ndarray, target: np.ndarray, block: int = 2048) -> np.ndarray:
    """Natural log probability of each target id: a head word, or a tail class as a whole."""
    kind = _kinds(target)
    out = np.empty(len(h), dtype=np.result_type(h, w["to_class"]))
    tame = _tame(w["to_class"], w["class_bias"])
    for at in range(0, len(h), block):  # what a block needs stays in the cache
        part = slice(at, at + block)
        scores = h[part] @ w["to_class"]
        scores += w["class_bias"]
        picked, total = _powers(scores, tame, kind[part])
        out[part] = picked - np.log(total)
    head, some = _by_class(kind)
    picked, total = _powers(_word_scores(w, h[head], some), _tame(w["to_word"], w["word_bias"]), target[head] % CLASS_SIZE)
    out[head] += picked - np.log(total)
    return out


def log_likelihoods(w: Weights, texts: list[np.ndarray], window: int = 32, rows: int = 512) -> np.ndarray:
    """Natural log-likelihood of complete texts (arrays of ids, the end among them).

    Texts of about the same length advance together, longest first; the state is carried from window
    to window and the outputs of a window are scored at once.
    """
    order = np.array(sorted(range(len(texts)), key=lambda i: -len(texts[i])), dtype=np.int64)
    out = np.zeros(len(texts))
    again, read = _by_gate(w["again"]), _by_gate(w["read"] + w["bias"])
    for at in range(0, len(order), rows):
        mine = order[at : at + rows]
        out[mine] = _together(w, again, read, [texts[i] for i in mine.tolist()], window)
    return out


def _together(w: Weights, again: np.ndarray, read: np.ndarray, texts: list[np.ndarray], window: int) -> np.ndarray:
    lengths = np.array([len(t) for t in texts])
    flat = np.concatenate(texts)
    ends = np.cumsum(lengths)
    total = np.zeros(len(texts))
    h = np.zeros((len(texts), UNITS), dtype=np.float32)
    last = np.full(len(texts), START, dtype=np.int64)
    for begin in range(0, int(lengths[0]), window):
        n = int(np.searchsorted(-lengths, -begin))
        stop = np.minimum(lengths[:n] - begin, window)
        # a row per step; behind its end a text gives its last id, which no one reads
        place = (ends - lengths)[:n] + begin + np.arange(int(stop[0]))[:, None]
        ids = flat[np.minimum(place, ends[:n] - 1)].astype(np.int64)
        states, targets = [], []
        alive = np.searchsorted(-stop, -np.arange(len(ids)))
        for t, count in enumerate(alive.tolist()):
            h = _step(again, read.take(last[:count], axis=1), h[:count])[-1]
            last = ids[t, :count]
            states.append(h)
            targets.append(last)
        owners = np.concatenate([np.arange(k) for k in alive.tolist()])
        total[:n] += np.bincount(owners, _log_chances(w, np.concatenate(states), np.concatenate(targets)), n)
    return total


def _slopes(
    w: Weights, ids: np.ndarray, target: np.ndarray, h: np.ndarray, weight: np.ndarray, room: Room | None = None
) -> tuple[Weights, np.ndarray]:
    """Gradient of the mean log-likelihood over one window, and the state behind it.

    ids, target: [time, stream]; an input START also sets the stream's state back to zero. The gradient lies in
    ``room`` until its next use.
    """
    steps, streams = ids.shape
    n, kind_of_number = steps * streams, np.result_type(h, w["again"])
    room = Room() if room is None else room

    def array(name: str, *shape: int) -> np.ndarray:
        return room(name, kind_of_number, *shape)

    again = _by_gate(w["again"])
    # becomes the gates and the fresh part
    x = _taken(_by_gate(w["read"] + w["bias"]), ids, array("x", 3, steps, streams, UNITS), axis=1)
    before, after, recurrent = (array(k, steps, streams, UNITS) for k in ("before", "after", "recurrent"))
    begins = ids == START
    some = begins.any(axis=1)
    for t in range(steps):
        before[t] = np.where(begins[t][:, None], np.float32(0), h) if some[t] else h
        *_, recurrent[t], _, h = _step(again, x[:, t], before[t], after[t])
    z, r, fresh = x
    states = after.reshape(-1, UNITS)
    goal, mass = target.reshape(-1), (weight / max(1.0, weight.sum())).reshape(-1).astype(np.float32)
    slopes = {k: array(f"slopes of {k}", *v.shape) for k, v in w.items()}
    for k in ("read", "to_word", "word_bias"):
        slopes[k].fill(0)
    kind = _kinds(goal)
    wrong = np.matmul(states, w["to_class"], out=array("wrong", n, CLASSES))
    wrong += w["class_bias"]
    _, total = _powers(wrong, _tame(w["to_class"], w["class_bias"]), kind)
    wrong *= (-mass / total)[:, None]
    wrong[np.arange(n), kind] += mass
    np.matmul(states.T, wrong, out=slopes["to_class"])
    np.matmul(np.ones(n, dtype=kind_of_number), wrong, out=slopes["class_bias"])
    back = np.matmul(wrong, w["to_class"].T, out=array("back", n, UNITS))
    head, classes = _by_class(kind)
    mine, place = _taken(states, head, array("mine", len(head), UNITS)), goal[head] % CLASS_SIZE
    inner = _word_scores(w, mine, classes, array("inner", len(head), CLASS_SIZE))
    _, total = _powers(inner, _tame(w["to_word"], w["word_bias"]), place)
    inner *= (-mass[head] / total)[:, None]
    inner[np.arange(len(head)), place] += mass[head]
    more = array("more", len(head), UNITS)
    for c, a, b in classes:
        np.matmul(mine[a:b].T, inner[a:b], out=slopes["to_word"][c])
        inner[a:b].sum(axis=0, out=slopes["word_bias"][c])
        np.matmul(inner[a:b], w["to_word"][c].T, out=more[a:b])
    more += _taken(back, head, mine)
    back[head] = more
    back = back.reshape(steps, streams, UNITS)
    # what does not depend on later steps is multiplied for all steps at once
    to_fresh, to_z, to_r, spare = (array(k, steps, streams, UNITS) for k in ("to fresh", "to z", "to r", "spare"))
    np.subtract(1, z, out=spare)
    np.multiply(fresh, fresh, out=to_fresh)
    np.subtract(1, to_fresh, out=to_fresh)
    to_fresh *= spare
    np.subtract(before, fresh, out=to_z)
    to_z *= z
    to_z *= spare
    np.subtract(1, r, out=to_r)
    to_r *= r
    to_r *= recurrent
    to_read, through = array("to read", 3, steps, streams, UNITS), array("through", steps, streams, UNITS)
    turned = [np.ascontiguousarray(w["again"][:, k * UNITS : (k + 1) * UNITS].T) for k in range(3)]
    carry = np.zeros((streams, UNITS), dtype=kind_of_number)
    for t in range(steps - 1, -1, -1):
        d = back[t]
        d += carry
        d_z, d_r, d_fresh = to_read[:, t]
        np.multiply(d, to_fresh[t], out=d_fresh)
        np.multiply(d, to_z[t], out=d_z)
        np.multiply(d_fresh, to_r[t], out=d_r)
        np.multiply(d_fresh, r[t], out=through[t])
        np.multiply(d, z[t], out=carry)
        carry += d_z @ turned[0]
        carry += d_r @ turned[1]
        carry += through[t] @ turned[2]
        if some[t]:
            carry *= ~begins[t][:, None]
    behind = before.reshape(-1, UNITS).T
    for k, d in enumerate((to_read[0], to_read[1], through)):
        slopes["again"][:, k * UNITS : (k + 1) * UNITS] = behind @ d.reshape(-1, UNITS)
    one = ids.reshape(-1).astype(np.int16)
    order = np.argsort(one, kind="stable")
    flat, part = array("flat", n, 3, UNITS), spare.reshape(-1, UNITS)
    for k in range(3):
        flat[:, k] = _taken(to_read[k].reshape(-1, UNITS), order, part)
    flat = flat.reshape(-1, 3 * UNITS)
    np.matmul(np.ones(n, dtype=kind_of_number), flat, out=slopes["bias"])
    starts = np.flatnonzero(np.diff(one[order], prepend=-1))
    read = one[order][starts]
    slopes["read"][read] = np.add.reduceat(flat, starts, axis=0, out=array("read", len(read), 3 * UNITS))
    return slopes, h.copy()


class Adam:
    def __init__(self, w: Weights, rate: float = RATE):
        self.rate, self.steps = rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in w.items()}
        self.square = {k: np.zeros_like(v) for k, v in w.items()}
        self.room = Room()

    def ascend(self, w: Weights, slopes: Weights) -> None:
        self.steps += 1
        size = float(np.sqrt(sum(np.vdot(g, g) for g in slopes.values())))
        scale = min(1.0, CLIP / max(size, 1e-12))
        for k, g in slopes.items():
            g *= scale
            part = self.room("part", g.dtype, *g.shape)
            np.subtract(g, self.mean[k], out=part)
            part *= 0.1
            self.mean[k] += part
            np.multiply(g, g, out=part)
            part -= self.square[k]
            part *= 0.01
            self.square[k] += part
            np.divide(self.square[k], 1 - 0.99**self.steps, out=part)
            np.sqrt(part, out=part)
            part += 1e-6
            np.divide(self.mean[k], part, out=part)
            part *= self.rate / (1 - 0.9**self.steps)
            w[k] += part


def train(w: Weights, texts: list[np.ndarray], rate: float = RATE) -> tuple[Weights, int]:
    """One pass of truncated backpropagation over texts; new weights and the number of tokens.

    Long texts are learnt in segments, so that no stream is much longer than the others.
    """
    texts = [t[at : at + SEGMENT] for t in texts for at in range(0, len(t), SEGMENT)]
    w = {k: v.copy() for k, v in w.items()}
    adam, room = Adam(w, rate), Room()
    # texts are dealt to parallel streams, longest first to the shortest stream
    width = min(STREAMS, max(1, sum(map(len, texts)) // STREAM_TOKENS))
    streams: list[list[np.ndarray]] = [[] for _ in range(width)]
    sizes = np.zeros(width, dtype=np.int64)
    for text in sorted(texts, key=len, reverse=True):
        s = int(sizes.argmin())
        streams[s].append(text)
        sizes[s] += len(text)
    longest = int(sizes.max()) if len(texts) else 0
    if not longest:
        return w, 0
    steps = -(-longest // WINDOW) * WINDOW
    ids = np.full((steps, width), START, dtype=np.int64)
    target = np.zeros((steps, width), dtype=np.int64)
    weight = np.zeros((steps, width), dtype=np.float32)
    for s, mine in enumerate(streams):
        at = 0
        for text in mine:
            n = len(text)
            ids[at + 1 : at + n, s] = text[:-1]
            target[at : at + n, s] = text
            weight[at : at + n, s] = 1
            at += n
    h = np.zeros((width, UNITS), dtype=np.float32)
    for at in range(0, steps, WINDOW):
        part = slice(at, at + WINDOW)
        slopes, h = _slopes(w, ids[part], target[part], h, weight[part], room)
        adam.ascend(w, slopes)
    return w, int(sizes.sum())


def size() -> int:
    return sum(int(np.prod(s)) for s in SHAPES.values())


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].reshape(-1) for k in SHAPES])


def shaped(values: np.ndarray) -> Weights:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = values[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out
