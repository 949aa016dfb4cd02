"""A character tagger in numpy: bidirectional recurrent network with CRF transitions, trained by gradient descent."""

from __future__ import annotations

import heapq

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "person")
TAGS = 1 + 2 * len(KINDS)  # 0 outside, then begin and inside of each kind
EMBED, HIDDEN = 16, 24
BARRED = -1e4
SIDE = 240  # characters of one product, which is faster than larger ones
TURNED = 32  # steps whose shares are turned into the order of the text at a time
ROUNDED = 32  # columns that are left at a time

#: May tag b follow tag a? Inside only after begin or inside of its kind.
ALLOWED = np.array([[b == 0 or b % 2 == 1 or (a in (b - 1, b) and a > 0) for b in range(TAGS)] for a in range(TAGS)])


class Alphabet:
    """Character numbers: one for each character of the training texts, and classes for all others."""

    def __init__(self, texts: list[str], least: int = 8) -> None:
        counts: dict[str, int] = {}
        for t in texts:
            for c in t:
                counts[c] = counts.get(c, 0) + 1
        kept = sorted(c for c, n in counts.items() if n >= least and not c.isdigit())
        self.own = {c: i + 8 for i, c in enumerate(kept)}
        self.size = len(self.own) + 8

    @staticmethod
    def class_of(c: str) -> int:
        if c.isdigit():
            return 1
        if c.isspace():
            return 2
        if c.isalpha():
            return 3 if ord(c) >= 0x2E80 else 4 if c.isupper() else 5
        return 6 if c.isprintable() else 7

    def table(self) -> np.ndarray:
        """Number of each code point; what lies above has the class of its block."""
        out = np.array([self.own.get(chr(i)) or self.class_of(chr(i)) for i in range(0x10000)], np.int32)
        return np.append(out, [3])

    @staticmethod
    def encode(table: np.ndarray, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return table[np.minimum(codes, 0x10000)]


def initial(size: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    out = {"embed": normal(size, EMBED, scale=0.3), "out": normal(2 * HIDDEN, TAGS, scale=0.2), "bias": np.zeros(TAGS, np.float32), "steps": np.zeros((TAGS, TAGS), np.float32)}
    for way in "fb":
        out |= {f"x{way}": normal(EMBED, 2 * HIDDEN, scale=0.25), f"h{way}": normal(HIDDEN, 2 * HIDDEN, scale=0.2), f"c{way}": np.zeros(2 * HIDDEN, np.float32)}
        out[f"c{way}"][:HIDDEN] = 0.75
    return out


def _gates(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of the old state that is kept, and the new state.

    The cell has this one gate, a straight line between its bounds. Its state lies between -1 and 1, is shown as it is
    and begins as ones.
    """
    return z[:, :HIDDEN].clip(0, 1), np.tanh(z[:, HIDDEN:])


def forward(p: dict[str, np.ndarray], x: np.ndarray, keep: bool) -> tuple[np.ndarray, dict]:
    """Tag scores (time, batch, tag) of numbers x (time, batch); with ``keep`` also what the gradient needs."""
    steps, batch = x.shape
    hidden = np.empty((steps, batch, 2 * HIDDEN), p["out"].dtype)
    memo: dict = {}
    for way in "fb":
        table = p["embed"] @ p[f"x{way}"] + p[f"c{way}"]
        h = np.ones((batch, HIDDEN), hidden.dtype)
        at = slice(0, HIDDEN) if way == "f" else slice(HIDDEN, 2 * HIDDEN)
        trace = []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            f, g = _gates(table[x[t]] + h @ p[f"h{way}"])
            before, h = h, g + f * (h - g)
            if keep:
                trace.append((t, before, f, g))
            hidden[t, :, at] = h
        memo[way] = trace
    memo["hidden"] = hidden
    return hidden @ p["out"] + p["bias"], memo


def _array(room: dict[str, np.ndarray], name: str, *shape: int) -> np.ndarray:
    """An array that isn't set, in what ``room`` holds by that name; fresh memory costs a twentieth of the scoring."""
    size = int(np.prod(shape))
    if name not in room or room[name].size < size:
        room[name] = np.empty(size, np.float32)
    return room[name][:size].reshape(shape)


def _shares(p: dict[str, np.ndarray], way: str, x: np.ndarray, lengths: np.ndarray | None = None, room: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """What one direction gives to the tag scores, (tag, batch, time) in the order of the text, over x (time, batch), whose rows are in its own order.

    Columns lie side by side, so that each half of the gates is one block and one product gives all gates of a step: of
    the state before it, of the character, of whether it is a break and of a one. With ``lengths``, which don't rise, a
    column is left where it ends; what stands beyond isn't set. The number after the last character is a break: behind
    it a column is as at its beginning, as nothing is kept and the new state is ones.
    """
    steps, batch = x.shape
    size, rows = len(p["embed"]), HIDDEN + EMBED + 2
    each = np.zeros((EMBED + 1, size + 1), np.float32)
    each[:EMBED, :size], each[EMBED, size] = p["embed"].T, 1
    anew = np.where(np.arange(2 * HIDDEN) < HIDDEN, BARRED, -BARRED)
    weights = np.ascontiguousarray(np.concatenate([p[f"h{way}"], p[f"x{way}"], anew[None], p[f"c{way}"][None]]).T, np.float32)
    own = np.ascontiguousarray((p["out"][:HIDDEN] if way == "f" else p["out"][HIDDEN:]).T, np.float32)
    many = np.full(steps, batch) if lengths is None else np.minimum(-(-np.searchsorted(-lengths, -np.arange(steps)) // ROUNDED) * ROUNDED, batch)
    given_all, z_all, h = np.empty(rows * batch, np.float32), np.empty(2 * HIDDEN * batch, np.float32), np.ones((HIDDEN, batch), np.float32)
    out, some, last = _array({} if room is None else room, "shares", TAGS, batch, steps), np.zeros((TURNED, TAGS, batch), np.float32), batch + 1
    for t, n in enumerate(many.tolist()):
        if n != last:
            # rows that follow one another without a gap are much faster than parts of longer rows
            before, last = h[:, :n].copy(), n
            given, z = given_all[: rows * n].reshape(rows, n), z_all[: 2 * HIDDEN * n].reshape(-1, n)
            h, f, g = given[:HIDDEN], z[:HIDDEN], z[HIDDEN:]
            h[:], given[-1] = before, 1
            products = [(given[:, k : k + SIDE], z[:, k : k + SIDE]) for k in range(0, n, SIDE)]
        each.take(x[t, :n], 1, given[HIDDEN:-1], "clip")
        for part, to in products:
            np.matmul(weights, part, out=to)
        f.clip(0, 1, f)
        np.tanh(g, out=g)
        h -= g
        h *= f
        h += g
        np.matmul(own, h, out=some[t % TURNED, :, :n])
        if t % TURNED == TURNED - 1 or t == steps - 1:
            low = t - t % TURNED
            turned = some[: t + 1 - low, :, : many[low]].transpose(1, 2, 0)
            if way == "f":
                out[:, : many[low], low : t + 1] = turned
            else:
                out[:, : many[low], steps - 1 - t : steps - low] = turned[:, :, ::-1]
    return out


def _scores(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The tag scores of ``forward`` without what the gradient needs."""
    return (_shares(p, "f", x) + _shares(p, "b", x[::-1])).transpose(2, 1, 0) + p["bias"]


def loss(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log likelihood of the tags y (time, batch) and its gradient."""
    scores, memo = forward(p, x, True)
    steps, batch, _ = scores.shape
    # forward and backward sums in scaled probabilities; every step's scale goes into the log likelihood
    move = np.where(ALLOWED, np.exp(np.where(ALLOWED, p["steps"], 0)), 0).astype(scores.dtype)
    top = scores.max(2, keepdims=True)
    emit = np.exp(scores - top)
    alpha, beta, scale = np.empty_like(scores), np.ones_like(scores), np.empty((steps, batch, 1), scores.dtype)
    for t in range(steps):
        a = emit[t] * (alpha[t - 1] @ move if t else ALLOWED[0])
        scale[t] = a.sum(1, keepdims=True)
        alpha[t] = a / scale[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = (emit[t + 1] * beta[t + 1]) @ move.T / scale[t + 1]
    total = (np.log(scale) + top).sum((0, 2))
    d_scores = alpha * beta
    d_moves = move * np.einsum("tba,tbc->ac", alpha[:-1], emit[1:] * beta[1:] / scale[1:], optimize=True)
    rows, cols = np.arange(steps)[:, None], np.arange(batch)
    gold = scores[rows, cols, y].sum(0) + p["steps"][y[:-1], y[1:]].sum(0)
    d_scores[rows, cols, y] -= 1
    np.add.at(d_moves, (y[:-1].ravel(), y[1:].ravel()), -1)
    d_scores /= batch
    grad = {"steps": np.where(ALLOWED, d_moves, 0).astype(np.float32) / batch, "bias": d_scores.sum((0, 1))}
    hidden = memo["hidden"]
    grad["out"] = np.einsum("tbh,tbk->hk", hidden, d_scores, optimize=True)
    d_hidden = d_scores @ p["out"].T
    grad["embed"] = np.zeros_like(p["embed"])
    order = np.argsort(x, axis=None, kind="stable")
    present, first = np.unique(x.ravel()[order], return_index=True)
    for way in "fb":
        at = slice(0, HIDDEN) if way == "f" else slice(HIDDEN, 2 * HIDDEN)
        dh = np.zeros((batch, HIDDEN), np.float32)
        dz_all = np.empty((steps, batch, 2 * HIDDEN), np.float32)
        d_own = np.zeros_like(p[f"h{way}"])
        for t, before, f, g in reversed(memo[way]):
            dh = dh + d_hidden[t, :, at]
            dz = np.concatenate([dh * (before - g) * ((f > 0) & (f < 1)), dh * (1 - f) * (1 - g * g)], 1)
            d_own += before.T @ dz
            dh = dh * f + dz @ p[f"h{way}"].T
            dz_all[t] = dz
        d_table = np.zeros((len(p["embed"]), 2 * HIDDEN), np.float32)
        d_table[present] = np.add.reduceat(dz_all.reshape(-1, 2 * HIDDEN)[order], first, axis=0)
        grad[f"h{way}"] = d_own
        grad[f"c{way}"] = d_table.sum(0)
        grad[f"x{way}"] = p["embed"].T @ d_table
        grad["embed"] += d_table @ p[f"x{way}"].T
    return float((total - gold).mean()), grad


def train(examples: list[tuple[np.ndarray, np.ndarray]], size: int, rounds: int, batch: int = 96, rate: float = 0.012, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam over random batches of (numbers, tags); shorter examples are padded with number 0 and tag 0."""
    rng = np.random.default_rng(seed)
    p = initial(size, seed)
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    order = np.empty(0, np.int64)
    for step in range(1, rounds + 1):
        if len(order) < batch:
            order = np.concatenate([order, rng.permutation(len(examples))])
        chosen, order = order[:batch], order[batch:]
        longest = max(len(examples[i][0]) for i in chosen)
        x, y = np.zeros((longest, len(chosen)), np.int64), np.zeros((longest, len(chosen)), np.int64)
        for n, i in enumerate(chosen):
            x[: len(examples[i][0]), n], y[: len(examples[i][1]), n] = examples[i]
        _, grad = loss(p, x, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        shrink = min(1.0, 5.0 / max(norm, 1e-9))
        pace = rate * min(1.0, step / 20) * (0.5 * (1 + np.cos(np.pi * step / rounds)) + 0.02)
        for k, g in grad.items():
            g = g * shrink
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] = p[k] - (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return p


def decode(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Most likely tags (time, batch) of numbers x (time, batch)."""
    return best_path(p["steps"], forward(p, x, False)[0])


def best_path(steps: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Most likely tags (time, batch) by scores (time, batch, tag). Columns in which nothing can beat "outside" everywhere are not searched."""
    moves = np.where(ALLOWED, steps, BARRED).astype(np.float32)
    gain = float(np.where(ALLOWED, steps, -np.inf).max() - steps[0, 0])
    live = np.flatnonzero(((scores[:, :, 1:].max(2) - scores[:, :, 0]) > -2 * max(gain, 0.0)).any(0))
    tags = np.zeros(scores.shape[:2], np.int8)
    if not len(live):
        return tags
    scores = scores[:, live]
    best = np.where(ALLOWED[0], scores[0], BARRED)
    back = np.empty((len(scores), len(live), TAGS), np.int8)
    for t in range(1, len(scores)):
        ways = best[:, :, None] + moves
        back[t] = ways.argmax(1)
        best = np.take_along_axis(ways, back[t][:, None, :].astype(np.int64), 1)[:, 0] + scores[t]
    last = best.argmax(1)
    for t in range(len(scores) - 1, -1, -1):
        tags[t, live] = last
        last = back[t][np.arange(len(live)), last] if t else last
    return tags


def _lanes(lengths: np.ndarray, together: int) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """Pieces laid end to end in at most ``together`` lanes of like length, with a break between: (piece, lane, start) of each, and the lanes' lengths, which don't rise."""
    ends = [(0, k) for k in range(min(together, len(lengths)))]
    laid = []
    for k in np.argsort(-lengths, kind="stable").tolist():  # the longest first, each into the shortest lane
        end, lane = ends[0]
        start = end + 1 if end else 0
        laid.append((k, lane, start))
        heapq.heapreplace(ends, (start + int(lengths[k]), lane))
    loads = np.zeros(len(ends), np.int64)
    for end, lane in ends:
        loads[lane] = end
    order = np.argsort(-loads, kind="stable")
    place = np.argsort(order, kind="stable").tolist()
    return [(k, place[lane], start) for k, lane, start in laid], loads[order]


def window_scores(p: dict[str, np.ndarray], codes: np.ndarray, sizes: np.ndarray, kept: list[tuple[int, int]], together: int = 720, room: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """Tag scores (place, tag) of the ``kept`` range of each window, one after the other; ``together`` windows at a time.

    ``codes`` holds the character numbers of all windows, of ``sizes`` characters each. Each direction begins at its end
    of a window and stops where the range ends for it. Where a window ends another one begins, so that as many characters
    are scored in each step. With ``room`` the scores hold until the next call with it.
    """
    room = {} if room is None else room
    low, high = np.array(kept, np.int64).reshape(-1, 2).T
    ends, place = np.cumsum(sizes), (np.cumsum(high - low) - (high - low)).tolist()
    sizes, low, high = np.asarray(sizes), low.tolist(), high.tolist()
    bias, out = p["bias"].astype(np.float32)[:, None], _array(room, "scores", TAGS, sum(high) - sum(low))
    if not place:
        return out.T
    codes = codes.astype(np.int32)
    for way in "fb":
        lengths = np.array(high) if way == "f" else sizes - low
        laid, loads = _lanes(lengths, together)
        begins, lengths, steps = (ends - sizes if way == "f" else len(codes) - ends).tolist(), lengths.tolist(), int(loads[0])
        x, in_order = np.full((len(loads), steps), len(p["embed"]), np.int32), codes if way == "f" else codes[::-1].copy()
        for k, lane, start in laid:
            x[lane, start : start + lengths[k]] = in_order[begins[k] : begins[k] + lengths[k]]
        shares = _shares(p, way, x.T.astype(np.intp, order="C"), loads, room)
        for k, lane, start in laid:
            to = out[:, place[k] : place[k] + high[k] - low[k]]
            if way == "f":
                np.add(shares[:, lane, start + low[k] : start + high[k]], bias, out=to)
            else:
                first = steps - start - lengths[k]  # the place of the range's first character
                to += shares[:, lane, first : first + high[k] - low[k]]
    return out.T


PLACES = 20_000  # places that are looked at together
GAP = -1e7  # between texts, so that no tagged run reaches from one into the next


def live(steps: np.ndarray, lead: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the most likely tags may be others than "outside"; everywhere else they can't.

    ``lead`` (tag, place) holds the scores of all other tags less that of "outside", ``starts`` the first places of the
    texts. A place is out when no mention of any kind that holds it would gain anything over "outside", whatever stands
    beside it: taking such a mention out of a path makes it better.
    """
    out = np.zeros(lead.shape[1], bool)
    for k, (enter, stay, more) in enumerate(_gains(steps)):
        total = np.add(lead[2 * k + 1], stay, dtype=np.float64)
        np.cumsum(total, out=total)
        begin = lead[2 * k] - total
        begin += enter
        begin[starts] += max(0.0, -enter)  # nothing is entered from at the first place
        np.maximum.accumulate(begin, out=begin)
        begin += np.maximum.accumulate(total[::-1])[::-1]
        out |= begin > -1e-2 - more
    return out


def _gains(steps: np.ndarray) -> list[tuple[float, float, float]]:
    """Of each kind the most that a mention gains by its beginning, by each further place and by its end, over "outside"."""
    moves = np.where(ALLOWED, steps, -np.inf).astype(np.float64) - float(steps[0, 0])
    enter, leave, joint = moves[0, 1::2], moves[1:, 0], moves[1:, 1::2]
    enter, leave = np.maximum(enter, (joint - leave[:, None]).max(0)), np.maximum(leave, (joint - enter).max(1))
    return [(float(enter[k]), float(stay := moves[2 * k + 2, 2 * k + 2]), float(max(0.0, moves[2 * k + 1, 2 * k + 2] - stay) + leave[2 * k : 2 * k + 2].max())) for k in range(len(KINDS))]


def _hopeful(steps: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Where a place alone may gain over "outside"; a text without such a place has no place that ``live`` finds."""
    out = np.zeros(lead.shape[1], bool)
    for k, (enter, stay, more) in enumerate(_gains(steps)):
        out |= lead[2 * k] > np.float32(-2e-2 - more - max(0.0, enter))
        out |= lead[2 * k + 1] > np.float32(-stay - 1e-3)
    return out


def _open(steps: np.ndarray, runs: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What ``live`` finds in the runs, each with a place behind it."""
    lead = np.empty((TAGS - 1, int(ends[-1])), np.float32)
    for r, start in zip(runs, starts.tolist()):
        np.subtract(r[:, 1:].T, r[:, 0], out=lead[:, start : start + len(r)])
    lead[:, ends - 1] = GAP
    out, sizes = np.zeros(lead.shape[1], bool), ends - starts
    some = np.logical_or.reduceat(_hopeful(steps, lead), starts)
    if some.any():
        own = np.repeat(some, sizes)
        out[own] = live(steps, lead if some.all() else lead[:, own], np.cumsum(sizes[some]) - sizes[some])
    return out


def decode_runs(steps: np.ndarray, runs: list[np.ndarray]) -> list[np.ndarray]:
    """Most likely tags of each run of scores (length, tag) as a whole.

    The places that may have other tags than "outside" are decoded, each stretch of them between places that can't; a run
    ends before one that is outside.
    """
    ends = np.cumsum([len(r) + 1 for r in runs], dtype=np.int64)
    starts = ends - [len(r) + 1 for r in runs]
    total = int(ends[-1]) if len(runs) else 0
    tags, found = np.zeros(total, np.int8), np.zeros(total, bool)
    cuts = [0, *(np.flatnonzero(np.diff(ends // PLACES)) + 1).tolist(), len(runs)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            found[starts[a] : ends[b - 1]] = _open(steps, runs[a:b], starts[a:b] - starts[a], ends[a:b] - starts[a])
    if (edges := np.flatnonzero(np.diff(found, prepend=False, append=False))).size:
        owner = np.searchsorted(ends, edges[::2], side="right")
        parts = []
        for n, low, high in zip(owner.tolist(), edges[::2].tolist(), edges[1::2].tolist()):
            start = int(starts[n])
            low, high = low - start, min(high - start, len(runs[n]))
            parts.append((high - low, n, low, high, start))
        parts.sort()
        for first in range(0, len(parts), 512):
            chunk = parts[first : first + 512]
            scores = np.full((chunk[-1][0] + 2, len(chunk), TAGS), BARRED, np.float32)
            scores[:, :, 0] = 0
            for k, (length, n, low, high, _) in enumerate(chunk):
                scores[low > 0 :, k][:length] = runs[n][low:high]  # before the first place of a run there is nothing
            found = best_path(steps, scores)
            for k, (length, _, low, _, start) in enumerate(chunk):
                tags[start + low : start + low + length] = found[int(low > 0) :, k][:length]
    return [tags[start : start + len(r)] for r, start in zip(runs, starts.tolist())]


def margins(steps: np.ndarray, scores: np.ndarray, tags: np.ndarray, found: list[tuple[int, int, str]]) -> list[float]:
    """By how much each tagged run scores above "outside" in its place."""
    before = np.concatenate([[0], tags[:-1]])
    gain = scores[np.arange(len(tags)), tags] - scores[:, 0] + steps[before, tags] - steps[0, 0]
    total = np.concatenate([[0.0], np.cumsum(gain)])
    return [float(total[b] - total[a] + (steps[tags[b - 1], 0] - steps[0, 0] if b < len(tags) else 0.0)) for a, b, _ in found]


def spans(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the tagged runs of one text."""
    out, start = [], -1
    for i, t in enumerate([*tags.tolist(), 0]):
        if start >= 0 and (t == 0 or t % 2 == 1):
            out.append((start, i, KINDS[(int(tags[start]) - 1) // 2]))
            start = -1
        if t % 2 == 1:
            start = i
    return out
