"""A gated recurrent language model in numpy: truncated backpropagation and a class-factored softmax.

Token 0 ends a text and also stands before its first word; token 1 is any word outside the vocabulary; the
vocabulary's words follow by falling frequency. Tokens 0 and 1 are classes of their own; each block of
`per_class` words is one class.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np

END, OTHER = 0, 1
NAMES = ("emb", "wx", "bx", "u", "un", "wc", "bc", "ww", "bw")


@dataclass(frozen=True)
class Shape:
    vocabulary: int
    embedding: int = 16
    hidden: int = 24
    per_class: int = 64

    @property
    def classes(self) -> int:
        return 2 + -(-self.vocabulary // self.per_class)

    @property
    def tokens(self) -> int:
        return self.vocabulary + 2

    def class_of(self, token: np.ndarray) -> np.ndarray:
        return np.where(token < 2, token, 2 + (token - 2) // self.per_class)

    def slot_of(self, token: np.ndarray) -> np.ndarray:
        return np.where(token < 2, 0, (token - 2) % self.per_class)


Weights = dict[str, np.ndarray]


def initial(shape: Shape, token_counts: np.ndarray, seed: int = 3) -> Weights:
    """Small random weights; biases make the untrained model predict token_counts."""
    rng, h, e = np.random.default_rng(seed), shape.hidden, shape.embedding
    log = np.log(token_counts + 0.5)
    token = np.arange(shape.tokens)
    bc, bw = np.full(shape.classes, -np.inf), np.full((shape.classes, shape.per_class), -1e9)
    np.logaddexp.at(bc, shape.class_of(token), log)
    bw[shape.class_of(token), shape.slot_of(token)] = log
    bc = np.where(np.isfinite(bc), bc, -1e9)
    normal = lambda *size: rng.normal(0, 1 / np.sqrt(size[0]), size)
    return {
        k: v.astype(np.float32)
        for k, v in {
            "emb": rng.normal(0, 0.3, (shape.tokens, e)), "wx": normal(e, 3 * h), "bx": np.zeros(3 * h), "u": normal(h, 2 * h), "un": normal(h, h),
            "wc": normal(h, shape.classes) * 0.1, "bc": bc - np.logaddexp.reduce(bc), "ww": rng.normal(0, 0.02, (shape.classes, shape.per_class, h)), "bw": bw - np.logaddexp.reduce(bw, axis=1, keepdims=True),
        }.items()
    }


def _sigmoid(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The sigmoid of x, whose place may be used, in out."""
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=out)


def streams(texts: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts (token ids with their end) laid end to end in `width` rows of about one length, longest first.

    Returns the rows' lengths, falling, and tables (steps, width): the token, and the text's number (-1: none).
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    loads, rows = np.zeros(width, np.int64), [[] for _ in range(width)]
    heap = [(0, r) for r in range(width)]
    for i in order:
        load, r = heapq.heappop(heap)
        rows[r].append(i)
        loads[r] = load + len(texts[i])
        heapq.heappush(heap, (int(loads[r]), r))
    by = np.argsort(-loads, kind="stable")
    steps = int(loads.max()) if len(texts) else 0
    token, owner = np.zeros((steps, width), np.int32), np.full((steps, width), -1, np.int32)
    for column, r in enumerate(by):
        at = 0
        for i in rows[r]:
            token[at : at + len(texts[i]), column] = texts[i]
            owner[at : at + len(texts[i]), column] = i
            at += len(texts[i])
    return loads[by], token, owner


def _inputs(token: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before each, END before a text's first; and whether the state is kept from the step before."""
    kept = np.zeros(owner.shape, bool)
    kept[1:] = owner[1:] == owner[:-1]
    before = np.full(token.shape, END, np.int32)
    before[1:][kept[1:]] = token[:-1][kept[1:]]
    return before, kept


def log_probabilities(w: Weights, shape: Shape, texts: list[np.ndarray], width: int = 384, window: int = 8) -> np.ndarray:
    """ln P of each text. The state runs through a whole text, window by window."""
    out = np.zeros(len(texts))
    if not texts:
        return out
    loads, token, owner = streams(texts, min(width, len(texts)))
    before, kept = _inputs(token, owner)
    table = w["emb"] @ w["wx"] + w["bx"]
    h2, biased = 2 * shape.hidden, _with_biases(w)
    h, held = np.zeros((token.shape[1], shape.hidden), np.float32), Held()
    for at in range(0, len(token), window):
        active = int((loads > at).sum())
        to = min(at + window, len(token))
        h = h[:active]
        states = held("states", (to - at, active, shape.hidden + 1), h.dtype)
        states[..., -1] = 1
        gates = np.take(table, before[at:to, :active], axis=0, out=held("gates", (to - at, active, table.shape[1]), h.dtype), mode="clip")
        keep = kept[at:to, :active, None].astype(np.float32)
        for t in range(to - at):
            h = h * keep[t]
            g, x = gates[t], h @ w["u"]
            x += g[:, :h2]
            zr = _sigmoid(x, x)
            n = (zr[:, shape.hidden :] * h) @ w["un"]
            n += g[:, h2:]
            np.tanh(n, out=n)
            h -= n
            h *= zr[:, : shape.hidden]
            h += n
            states[t, :, :-1] = h
        real = owner[at:to, :active] >= 0
        targets, owners = token[at:to, :active][real], owner[at:to, :active][real]
        out += np.bincount(owners, _target_logs(biased, shape, states[real], targets, held), len(texts))
    return out


def _target_logs(biased: tuple[np.ndarray, np.ndarray, bool], shape: Shape, states: np.ndarray, targets: np.ndarray, held: Held) -> np.ndarray:
    """ln P of targets after states, which have a last column of ones."""
    between, inside, tame = biased
    classes = shape.class_of(targets)
    order = np.argsort(classes, kind="stable")
    ends = np.searchsorted(classes[order], np.arange(shape.classes + 1)).tolist()
    own, there = states[order], order[ends[2] :]
    # a target's own logit apart, as its power may be nothing
    logits = np.matmul(own, between, out=held("between", (len(own), shape.classes), own.dtype))
    if not tame:
        logits -= logits.max(axis=1, keepdims=True)
    logs = logits[np.arange(len(own)), classes[order]].astype(np.float64)
    logs -= np.log(_powers(logits, True, 0)[1])
    q = _inner(inside, own, ends, held)
    if not tame:
        q -= q.max(axis=1, keepdims=True)
    add = q[np.arange(len(q)), shape.slot_of(targets[there])]
    logs[ends[2] :] += add - np.log(_powers(q, True, 0)[1])
    out = np.empty_like(logs)
    out[order] = logs
    return out


class Held:
    """Arrays that windows use again; memory that goes back to the system each time costs more than what is done in it."""

    def __init__(self) -> None:
        self.arrays: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...], dtype: np.dtype) -> np.ndarray:
        size = math.prod(shape)
        found = self.arrays.get(name)
        if found is None or found.size < size or found.dtype != dtype:
            found = self.arrays[name] = np.empty(size, dtype)
        return found[:size].reshape(shape)


#: Logits within this are taken as they are; others lose their row's greatest first.
TAME = 60


def _with_biases(w: Weights) -> tuple[np.ndarray, np.ndarray, bool]:
    """Weights of the classes and of the words inside them with the biases as a last row or column; and whether all logits are tame."""
    between, inside = np.concatenate([w["wc"], w["bc"][None]]), np.concatenate([w["ww"], w["bw"][..., None]], axis=2)
    # a state is within -1 and 1; biases of -1e9 stand for no word
    tame = all(np.abs(x).sum(axis=axis).max(initial=0) + np.abs(y[y > -1e8]).max(initial=0) < TAME for x, axis, y in ((w["wc"], 0, w["bc"]), (w["ww"], 2, w["bw"])))
    return between, inside, tame


def _powers(logits: np.ndarray, tame: bool, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp of the logits, in their place and up to a factor of the row; its sums; and the chosen one of each row."""
    if not tame:
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    return logits, logits @ np.ones(logits.shape[1], logits.dtype), logits[np.arange(len(logits)), chosen]


def _inner(inside: np.ndarray, own: np.ndarray, ends: list[int], held: Held) -> np.ndarray:
    """Logits inside their class of states in order of their classes; those of classes without blocks come first and are left out."""
    q = held("q", (len(own) - ends[2], inside.shape[1]), own.dtype)
    for c in range(2, len(ends) - 1):
        if ends[c + 1] > ends[c]:
            np.matmul(own[ends[c] : ends[c + 1]], inside[c].T, out=q[ends[c] - ends[2] : ends[c + 1] - ends[2]])
    return q


def window_gradients(w: Weights, shape: Shape, h0: np.ndarray, before: np.ndarray, kept: np.ndarray, targets: np.ndarray, real: np.ndarray, held: Held | None = None) -> tuple[float, Weights, np.ndarray]:
    """(summed loss, gradients of its mean, last state) of one window; gradients stop at the window's start."""
    steps, width = before.shape
    hd, h2 = shape.hidden, 2 * shape.hidden
    x = w["emb"][before]
    gates = x @ w["wx"] + w["bx"]
    keep = kept[..., None].astype(w["u"].dtype)
    kind, held = w["u"].dtype, held or Held()
    hin, zr, n, states, dn, dzr, dstates, of_n, of_z, of_r = (held(f"step {i}", (steps, width, k), kind) for i, k in enumerate((hd, h2, hd, hd, hd, h2, hd, hd, hd, hd)))
    h = h0
    for t in range(steps):
        np.multiply(h, keep[t], out=hin[t])
        y = hin[t] @ w["u"]
        y += gates[t, :, :h2]
        _sigmoid(y, zr[t])
        y = (zr[t, :, hd:] * hin[t]) @ w["un"]
        y += gates[t, :, h2:]
        np.tanh(y, out=n[t])
        h = np.subtract(hin[t], n[t], out=states[t])
        h *= zr[t, :, :hd]
        h += n[t]
    grads: Weights = {}
    between, inside, tame = _with_biases(w)
    y = targets[real]
    s = np.ones((len(y), hd + 1), kind)
    s[:, :hd] = states[real]
    count = max(1, len(y))
    classes, slots, rows = shape.class_of(y), shape.slot_of(y), np.arange(len(y))
    p, sums, own_p = _powers(s @ between, tame, classes)
    loss = -float(np.log(np.maximum(own_p / sums, 1e-30)).sum())
    p *= (1 / (sums * count))[:, None]
    p[rows, classes] -= 1 / count
    grad = s.T @ p
    grads["wc"], grads["bc"] = grad[:-1], grad[-1]
    ds = p @ w["wc"].T
    # tokens by class, so that each class takes a slice
    order = np.argsort(classes, kind="stable")
    ends = np.searchsorted(classes[order], np.arange(shape.classes + 1)).tolist()
    own, own_ds, own_slots = s[order], np.zeros_like(ds), slots[order[ends[2] :]]
    q, sums, own_q = _powers(_inner(inside, own, ends, held), tame, own_slots)
    loss -= float(np.log(np.maximum(own_q / sums, 1e-30)).sum())
    q *= (1 / (sums * count))[:, None]
    q[np.arange(len(q)), own_slots] -= 1 / count
    grad = np.zeros_like(inside)
    for c in range(2, shape.classes):
        at, part = slice(ends[c], ends[c + 1]), q[ends[c] - ends[2] : ends[c + 1] - ends[2]]
        if len(part):
            np.matmul(part.T, own[at], out=grad[c])
            np.matmul(part, w["ww"][c], out=own_ds[at])
    grads["ww"], grads["bw"] = np.ascontiguousarray(grad[..., :-1]), np.ascontiguousarray(grad[..., -1])
    ds[order] += own_ds
    last = h.copy()
    dstates[~real] = 0
    dstates[real] = ds
    dgates, dh = gates, np.zeros_like(h0)
    # what no step changes, for all of them at once
    z, r = zr[..., :hd], zr[..., hd:]
    np.subtract(1, z, out=of_n)
    np.subtract(hin, n, out=of_z)
    of_z *= of_n
    of_z *= z
    n *= n
    of_n *= np.subtract(1, n, out=n)
    rh = np.multiply(hin, r, out=n)
    np.subtract(1, r, out=of_r)
    of_r *= rh
    back_n, back_zr = np.ascontiguousarray(w["un"].T), np.ascontiguousarray(w["u"].T)
    for t in range(steps - 1, -1, -1):
        dh += dstates[t]
        np.multiply(dh, of_n[t], out=dn[t])
        drh = dn[t] @ back_n
        np.multiply(dh, of_z[t], out=dzr[t, :, :hd])
        np.multiply(drh, of_r[t], out=dzr[t, :, hd:])
        dh *= z[t]
        drh *= r[t]
        dh += drh
        dh += dzr[t] @ back_zr
        dh *= keep[t]
    dgates[..., :h2], dgates[..., h2:] = dzr, dn
    grads["un"], grads["u"] = rh.reshape(-1, hd).T @ dn.reshape(-1, hd), hin.reshape(-1, hd).T @ dzr.reshape(-1, h2)
    flat = dgates.reshape(-1, 3 * hd)
    grads["wx"], grads["bx"] = x.reshape(-1, shape.embedding).T @ flat, flat.sum(axis=0)
    at, back = before.reshape(-1), flat @ w["wx"].T
    each = at[:, None] * shape.embedding + np.arange(shape.embedding)
    grads["emb"] = np.bincount(each.reshape(-1), back.reshape(-1), w["emb"].size).reshape(w["emb"].shape).astype(kind)
    return loss, grads, last


#: Rows side by side in training: as many as leave STEPS steps to a pass, within these.
NARROW, WIDE, STEPS = 16, 128, 300


def train(w: Weights, shape: Shape, texts: list[np.ndarray], rate: float = 0.01, width: int | None = None, window: int = 16) -> Weights:
    """One pass of Adam over texts, in truncated windows; states run on from window to window."""
    w = {k: v.copy() for k, v in w.items()}
    if not texts:
        return w
    width = width or min(WIDE, max(NARROW, sum(map(len, texts)) // (window * STEPS)))
    _, token, owner = streams(texts, min(width, len(texts)))
    before, kept = _inputs(token, owner)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    h, held = np.zeros((token.shape[1], shape.hidden), np.float32), Held()
    total = -(-len(token) // window)
    for k, at in enumerate(range(0, len(token), window), 1):
        part = slice(at, at + window)
        real = owner[part] >= 0
        if not real.any():
            break
        _, grads, h = window_gradients(w, shape, h, before[part], kept[part], token[part], real, held)
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
        clip = min(1.0, 1.0 / (norm + 1e-9))
        step = rate * (1 - 0.9 * k / total) * np.sqrt(1 - 0.999**k) / (1 - 0.9**k)
        for name, g in grads.items():
            # in place, as the arrays are far larger than what a window adds to them
            g *= clip
            m[name] *= 0.9
            m[name] += 0.1 * g
            g *= g
            g *= 0.001
            v[name] *= 0.999
            v[name] += g
            np.sqrt(v[name], out=g)
            g += 1e-8
            np.divide(m[name], g, out=g)
            g *= step
            w[name] -= g
    return w


def packed(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].astype(np.float32).reshape(-1) for k in NAMES])


def unpacked(flat: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in NAMES:
        out[k] = np.asarray(flat[at : at + like[k].size], np.float32).reshape(like[k].shape)
        at += like[k].size
    return out
