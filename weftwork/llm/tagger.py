"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Each character enters as a row of a table for its code and one for its dictionary flag (whether its word is a listed
given name), already multiplied by the input weights. All arrays are time-major float32.
"""

from __future__ import annotations

import io
import unicodedata

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "name")
TAGS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
O, K = 0, len(TAGS)
PAD = 0
#: Latin letters beyond ASCII with codes of their own; every other character falls into a class.
_EXTRA = "áàâäãåæçéèêëíìîïñóòôöõøœúùûüýÿßÁÀÂÄÃÇÉÈÊËÍÎÏÑÓÔÖÚÙÛÜŒ€£°ºª’‘“”«»–—…•№ "
_CODES = {c: k for k, c in enumerate([chr(x) for x in range(32, 127)] + list("\n\t") + list(_EXTRA), start=1)}
_CLASSES = {c: len(_CODES) + 1 + k for k, c in enumerate(("Lu", "Ll", "Lo", "Nd", "P", "S", "Z", "C"))}
CODES = len(_CODES) + len(_CLASSES) + 1
FLAGS = 3


def char_codes(text: str) -> np.ndarray:
    """One code per character."""
    known = _CODES.get
    return np.fromiter((known(c) or _class(c) for c in text), dtype=np.uint8, count=len(text))


def _class(c: str) -> int:
    kind = unicodedata.category(c)
    return _CLASSES.get(kind) or _CLASSES.get(kind[0]) or (_CLASSES["Lo"] if kind[0] in "LM" else _CLASSES["Nd"] if kind[0] == "N" else _CLASSES["C"])


def allowed() -> np.ndarray:
    """0 where a tag may follow another, a large negative number where not (an I- tag needs its B- or I-)."""
    bad = np.zeros((K, K), dtype=np.float32)
    for to in range(2, K, 2):
        bad[:, to] = -1e4
        bad[to - 1, to] = bad[to, to] = 0
    return bad


FORBIDDEN = allowed()
START = np.array([0 if not t.startswith("I") else -1e4 for t in TAGS], dtype=np.float32)


def fresh(hidden: int, seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w: dict[str, np.ndarray] = {}
    for d in "fb":
        w[f"{d}_code"] = (r.standard_normal((CODES, 4 * hidden)) * 0.3).astype(np.float32)
        w[f"{d}_flag"] = np.zeros((FLAGS, 4 * hidden), dtype=np.float32)
        w[f"{d}_rec"] = (r.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        w[f"{d}_bias"] = np.zeros(4 * hidden, dtype=np.float32)
        w[f"{d}_bias"][hidden : 2 * hidden] = 1.0
        w[f"{d}_out"] = (r.standard_normal((hidden, K)) / np.sqrt(hidden)).astype(np.float32)
    w["out_bias"] = np.zeros(K, dtype=np.float32)
    w["move"] = np.zeros((K, K), dtype=np.float32)
    return w


def pack(w: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **w)
    return out.getvalue()


def unpack(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as f:
        return {k: f[k] for k in f.files}


def lstm(codes: np.ndarray, flags: np.ndarray, w: dict[str, np.ndarray], keep: bool):
    """Hidden states T x 2 x B x H of both directions, the second one in reversed time, so that one step serves both.

    With ``keep`` also gates, cells and their tanh for the way back. tanh is taken as 2 sigmoid(2x) - 1, so that one
    exp serves all gates of a step.
    """
    t, b = codes.shape
    n = w["f_rec"].shape[0]
    double = np.ones(4 * n, dtype=np.float32)
    double[3 * n :] = 2
    rec = np.stack([w["f_rec"], w["b_rec"]]) * -double
    table = np.concatenate([(w[f"{d}_code"][:, None, :] + w[f"{d}_flag"][None]).reshape(-1, 4 * n) + w[f"{d}_bias"] for d in "fb"]) * -double
    which = codes.astype(np.int32) * FLAGS + flags
    which = np.stack([which, which[::-1] + CODES * FLAGS], axis=1)
    h = np.zeros((2, b, n), dtype=rec.dtype)
    c = np.zeros((2, b, n), dtype=rec.dtype)
    tc = np.empty((2, b, n), dtype=rec.dtype)
    out = np.empty((t, 2, b, n), dtype=rec.dtype)
    gates = np.empty((t if keep else 1, 2, b, 4 * n), dtype=rec.dtype)
    cells, tanhs = (np.empty((t, 2, b, n), dtype=rec.dtype) for _ in range(2)) if keep else (None, None)
    drawn = np.empty((2, b, 4 * n), dtype=rec.dtype)
    old = np.seterr(over="ignore")  # an infinite exp is a gate of 0
    for step in range(t):
        z = gates[step if keep else 0]
        np.matmul(h, rec, out=z)
        np.take(table, which[step], axis=0, out=drawn, mode="clip")
        z += drawn
        np.exp(z, out=z)
        z += 1
        np.reciprocal(z, out=z)
        g = z[..., 3 * n :]
        g *= 2
        g -= 1
        c = z[..., n : 2 * n] * c
        c += z[..., :n] * g
        np.multiply(c, -2, out=tc)
        np.exp(tc, out=tc)
        tc += 1
        np.divide(2, tc, out=tc)
        tc -= 1
        h = np.multiply(z[..., 2 * n : 3 * n], tc, out=out[step])
        if keep:
            cells[step], tanhs[step] = c, tc
    np.seterr(**old)
    return out, gates, cells, tanhs, which


def tag_scores(out: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """T x B x K scores from the hidden states of both directions."""
    return out[:, 0] @ w["f_out"] + out[::-1, 1] @ w["b_out"] + w["out_bias"]


def emissions(codes: np.ndarray, flags: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """T x B x K scores of each tag."""
    return tag_scores(lstm(codes, flags, w, False)[0], w)


def viterbi(scores: np.ndarray, lengths: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """The best tags (T x B) of texts that end at ``lengths``; what lies behind is O."""
    t, b, _ = scores.shape
    into = np.ascontiguousarray((w["move"] + FORBIDDEN).T)  # to x from
    by_tag = np.ascontiguousarray(scores.transpose(0, 2, 1))  # texts last: each step works along them
    best = np.empty((t, K, b), dtype=np.float32)
    best[0] = by_tag[0] + START[:, None]
    reached = np.empty((K, b), dtype=np.float32)
    # An I- tag follows only its own B- and I-; O and B- tags follow any.
    free, begin, inner = np.r_[0, 1:K:2], slice(1, K, 2), slice(2, K, 2)
    into_free = into[free][:, :, None]
    from_begin, from_inner = (into[np.arange(2, K, 2), np.arange(k, K, 2)][:, None] for k in (1, 2))
    every = np.empty((len(free), K, b), dtype=np.float32)
    for step in range(1, t):
        before = best[step - 1]
        np.add(before, into_free, out=every)
        reached[free] = every.max(axis=1)
        np.maximum(before[begin] + from_begin, before[inner] + from_inner, out=reached[inner])
        np.add(reached, by_tag[step], out=best[step])
        ended = step >= lengths
        if ended.any():
            best[step][:, ended] = before[:, ended]
    tags = np.zeros((t, b), dtype=np.uint8)
    at = best[-1].argmax(axis=0)
    for step in range(t - 1, -1, -1):
        inside = step < lengths
        tags[step] = np.where(inside, at, O)
        if step:
            at = np.where(inside, (best[step - 1] + into[at].T).argmax(axis=0), at)
    return tags


def gradients(codes: np.ndarray, flags: np.ndarray, gold: np.ndarray, mask: np.ndarray, w: dict[str, np.ndarray]):
    """Negative log likelihood per character and its gradient. ``mask`` (T x B) is 1 on text, 0 on the padding after."""
    t, b = codes.shape
    n = w["f_rec"].shape[0]
    out, gates, cells, tanhs, which = lstm(codes, flags, w, True)
    scores = tag_scores(out, w)
    move = w["move"] + FORBIDDEN

    # Forward and backward sums, scaled to 1 at every step.
    top = scores.max(axis=2, keepdims=True)
    psi, step_to = np.exp(scores - top), np.exp(move)
    alpha, c = np.empty_like(psi), np.ones((t, b, 1), dtype=psi.dtype)
    first = psi[0] * np.exp(START)
    c[0] = first.sum(axis=1, keepdims=True)
    alpha[0] = first / c[0]
    for s in range(1, t):
        new = (alpha[s - 1] @ step_to) * psi[s]
        c[s] = np.where(mask[s][:, None] > 0, new.sum(axis=1, keepdims=True), 1)
        alpha[s] = np.where(mask[s][:, None] > 0, new / c[s], alpha[s - 1])
    beta = np.ones_like(psi)
    for s in range(t - 2, -1, -1):
        new = (psi[s + 1] * beta[s + 1] / c[s + 1]) @ step_to.T
        beta[s] = np.where(mask[s + 1][:, None] > 0, new, beta[s + 1])
    total = mask.sum()
    marginal = alpha * beta * mask[:, :, None]
    ahead = (psi[1:] * beta[1:] / c[1:] * mask[1:][:, :, None]).reshape(-1, K)
    expected = (alpha[:-1].reshape(-1, K).T @ ahead) * step_to
    hot = np.eye(K, dtype=np.float32)[gold] * mask[:, :, None]
    seen = hot[:-1].reshape(-1, K).T @ hot[1:].reshape(-1, K)
    score = (scores * hot).sum() + (w["move"] * seen).sum()
    loss = float(((np.log(c) + top)[:, :, 0] * mask).sum() - score) / total

    g: dict[str, np.ndarray] = {"move": ((expected - seen) / total).astype(np.float32)}
    d_scores = ((marginal - hot) / total).astype(np.float32)
    g["out_bias"] = d_scores.sum(axis=(0, 1))
    flat = d_scores.reshape(-1, K)
    g["f_out"] = out[:, 0].reshape(-1, n).T @ flat
    g["b_out"] = out[::-1, 1].reshape(-1, n).T @ flat
    d_out = np.stack([d_scores @ w["f_out"].T, d_scores[::-1] @ w["b_out"].T], axis=1)
    i, f, o, u = (gates[..., k * n : (k + 1) * n] for k in range(4))
    before = np.zeros_like(cells)
    before[1:] = cells[:-1]
    by_cell = np.stack([u * i * (1 - i), before * f * (1 - f), i * (1 - u * u)], axis=3)  # T x 2 x B x 3 x H
    by_hidden = tanhs * o * (1 - o)
    to_cell = o * (1 - tanhs * tanhs)
    d_z = np.empty((t, 2, b, 4 * n), dtype=out.dtype)
    d_h = np.zeros((2, b, n), dtype=out.dtype)
    d_c = np.zeros((2, b, n), dtype=out.dtype)
    rec_t = np.ascontiguousarray(np.stack([w["f_rec"].T, w["b_rec"].T]))
    for s in range(t - 1, -1, -1):
        d_h += d_out[s]
        d_c += d_h * to_cell[s]
        block = d_z[s].reshape(2, b, 4, n)
        np.multiply(by_cell[s, :, :, :2], d_c[:, :, None], out=block[:, :, :2])
        np.multiply(by_hidden[s], d_h, out=block[:, :, 2])
        np.multiply(by_cell[s, :, :, 2], d_c, out=block[:, :, 3])
        d_c *= f[s]
        d_h = d_z[s] @ rec_t
    shifted = np.zeros_like(out)
    shifted[1:] = out[:-1]
    for k, d in enumerate("fb"):
        rows = d_z[:, k].reshape(-1, 4 * n)
        g[f"{d}_rec"] = shifted[:, k].reshape(-1, n).T @ rows
        g[f"{d}_bias"] = rows.sum(axis=0)
        index = which[:, k].ravel() - k * CODES * FLAGS
        order = np.argsort(index, kind="stable")
        used, starts = np.unique(index[order], return_index=True)
        summed = np.add.reduceat(rows[order], starts, axis=0)
        g[f"{d}_code"] = np.zeros_like(w[f"{d}_code"])
        g[f"{d}_flag"] = np.zeros_like(w[f"{d}_flag"])
        np.add.at(g[f"{d}_code"], used // FLAGS, summed)
        np.add.at(g[f"{d}_flag"], used % FLAGS, summed)
    return loss, g


def train(w: dict[str, np.ndarray], codes: np.ndarray, flags: np.ndarray, gold: np.ndarray, lengths: np.ndarray, passes: float, rate: float, batch: int, seed: int, warm: int = 0) -> tuple[dict[str, np.ndarray], float]:
    """Adam over windows (N x T), in random order; the weights after it and the mean loss."""
    rng = np.random.default_rng(seed)
    w = {k: v.copy() for k, v in w.items()}
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v2 = {k: np.zeros_like(v) for k, v in w.items()}
    n, losses, step = len(codes), [], 0
    order = np.concatenate([rng.permutation(n) for _ in range(int(np.ceil(passes)))])[: max(batch, int(n * passes))]
    for at in range(0, len(order), batch):
        pick = order[at : at + batch]
        longest = int(lengths[pick].max())
        mask = (np.arange(longest)[:, None] < lengths[pick][None]).astype(np.float32)
        loss, g = gradients(codes[pick, :longest].T, flags[pick, :longest].T, gold[pick, :longest].T, mask, w)
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = min(1.0, 1.0 / (norm + 1e-6))
        step += 1
        now = rate * min(1.0, step / max(1, warm))
        for k, x in g.items():
            x = x * scale
            m[k] += 0.1 * (x - m[k])
            v2[k] += 0.01 * (x * x - v2[k])
            w[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)
        losses.append(loss)
    return w, float(np.mean(losses))
