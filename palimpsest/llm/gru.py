"""A gated recurrent network over words, in numpy, for many documents at once.

Documents lie side by side as lanes. A lane's state is carried from window to window over the
whole document; gradients stop at a window's start (truncated backpropagation). The output is
factored by classes, and both factors are softmaxes on the state: one over classes, and for each class one over its slots.
A token is its slot's number, class x slots + slot within the class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WINDOW = 32
HIDDEN = 16
PREDICTED_AT_ONCE = 1 << 15


def log_softmax(logits: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's log-probability of its target, and its sum of exponentials, which ``logits`` become in place."""
    if logits.max(initial=0) > 60:
        np.minimum(logits, 60, out=logits)
    at_target = logits[np.arange(len(targets)), targets]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    return at_target - np.log(total), total


def softmax(logits: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Each row's log-probability of its target; ``logits`` become probabilities in place."""
    found, total = log_softmax(logits, targets)
    logits *= (1 / total)[:, None]
    return found


class Network:
    """Parameters: inputs (a row of 3H for each token), state (H x 3H), class output (H x classes), slot outputs (classes x H x slots), and biases.

    Gates in order: update, reset, candidate. The prediction of a token comes from the state
    after all tokens before it; the first one's comes from a state of zeros.
    """

    NAMES = ("inputs", "state", "gate_bias", "to_class", "class_bias", "to_slot", "slot_bias")

    def __init__(self, classes: int, slots: int, hidden: int = HIDDEN, log_shares: np.ndarray | None = None, seed: int = 7):
        """``log_shares``: (classes x slots) log of each token's share, from which the biases start."""
        rng = np.random.default_rng(seed)
        self.classes, self.slots, self.hidden = classes, slots, hidden
        shapes = ((classes * slots, 3 * hidden), (hidden, 3 * hidden), (3 * hidden,), (hidden, classes), (classes,), (classes, hidden, slots), (classes, slots))
        self.sizes = [int(np.prod(s)) for s in shapes]
        self.vector = np.zeros(sum(self.sizes), np.float32)
        for name, shape, start, size in zip(self.NAMES, shapes, np.cumsum([0, *self.sizes]), self.sizes, strict=False):
            setattr(self, name, self.vector[start : start + size].reshape(shape))
        self.inputs[:] = rng.normal(0, 0.3, self.inputs.shape)
        self.state[:] = rng.normal(0, 1 / np.sqrt(hidden), self.state.shape)
        self.gate_bias[:hidden] = 1.0
        if log_shares is not None:
            whole = np.logaddexp.reduce(log_shares, axis=1)
            self.class_bias[:] = whole
            self.slot_bias[:] = log_shares - whole[:, None]

    def load(self, vector: np.ndarray) -> Network:
        self.vector[:] = vector
        return self

    def forward(self, tokens: np.ndarray, active: list[int], h: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """States before each step (steps x lanes x H) and what gradients() needs. ``h`` is carried on in place.

        Where ``first`` says that a token begins a document, the state is zero before it.
        """
        H, kind = self.hidden, self.vector.dtype
        inputs = self.inputs[tokens]
        inputs += self.gate_bias
        shape = (len(active), len(h), H)
        before, candidates, resets = np.zeros(shape, kind), np.zeros(shape, kind), np.zeros(shape, kind)
        gates = np.zeros((*shape[:2], 2 * H), kind)
        for s, n in enumerate(active):
            old = before[s, :n]
            if first is None:
                old[:] = h[:n]
            else:
                np.multiply(h[:n], ~first[s, :n, None], out=old)
            x, u = inputs[s, :n], old @ self.state
            g = gates[s, :n]
            np.add(x[:, : 2 * H], u[:, : 2 * H], out=g)
            g *= 0.5
            np.tanh(g, out=g)
            g += 1
            g *= 0.5
            resets[s, :n] = u[:, 2 * H :]
            c = candidates[s, :n]
            np.multiply(g[:, H:], u[:, 2 * H :], out=c)
            c += x[:, 2 * H :]
            np.tanh(c, out=c)
            np.subtract(old, c, out=h[:n])
            h[:n] *= g[:, :H]
            h[:n] += c
        return before, (gates, candidates, resets)

    def by_class(self, targets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """(the order of targets by token, and in that order: class, first, after). Classes of one slot only are left out."""
        order = np.argsort(targets.astype(np.uint16) if self.classes * self.slots <= 1 << 16 else targets, kind="stable")  # short numbers are sorted by radix
        edges = np.searchsorted(targets[order], np.arange(self.classes + 1) * self.slots).tolist()
        return order, [(c, a, b) for c, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]

    def log_probabilities(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """The log-probability of each target: that of its class, and of its slot within the class."""
        logits = states @ self.to_class
        logits += self.class_bias
        out = log_softmax(logits, targets // self.slots)[0]
        order, runs = self.by_class(targets)
        states, slots = states[order], targets[order] % self.slots
        own = np.zeros_like(out)
        for c, a, b in runs:
            logits = states[a:b] @ self.to_slot[c]
            logits += self.slot_bias[c]
            own[a:b] = log_softmax(logits, slots[a:b])[0]
        out[order] += own
        return out


class Lanes:
    """Streams of tokens side by side, the longest first: documents (none of them empty), or all of them in ``lanes`` streams of one length."""

    def __init__(self, documents: list[np.ndarray], lanes: int | None = None):
        self.order = sorted(range(len(documents)), key=lambda i: -len(documents[i])) if lanes is None else list(range(len(documents)))
        sizes = np.array([len(documents[i]) for i in self.order], np.int64)
        self.flat = np.concatenate([documents[i] for i in self.order]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
        begins = np.cumsum(sizes) - sizes
        self.first = np.zeros(len(self.flat), bool)
        self.first[begins] = True
        if lanes is None:
            self.lengths, self.starts = sizes, begins
        else:
            # A stream that begins within a document does so with a state of zeros.
            size = max(1, -(-len(self.flat) // lanes))
            self.starts = np.arange(0, len(self.flat), size)
            self.lengths = np.minimum(size, len(self.flat) - self.starts)

    def windows(self, width: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
        """(tokens, whether each begins a document: both steps x lanes; how many lanes are active at each step)."""
        longest = int(self.lengths[0]) if len(self.lengths) else 0
        for t in range(0, longest, width):
            steps = np.arange(t, min(t + width, longest))
            active = np.searchsorted(-self.lengths, -steps, "left").tolist()
            at = np.minimum(self.starts[: active[0]] + steps[:, None], len(self.flat) - 1)
            yield self.flat[at], self.first[at], active


def log10_likelihoods(network: Network, documents: list[np.ndarray], lanes: int = 1024) -> np.ndarray:
    """Each document's log10 probability of its tokens, whole, with the state carried across windows."""
    out, waiting, size = np.zeros(len(documents)), [], 0

    def flush() -> None:
        """Predictions of several windows at once: where few lanes go on, a window is a few tokens."""
        if waiting:
            states, targets, whose = (np.concatenate(x) for x in zip(*waiting, strict=True))
            out[:] += np.bincount(whose, network.log_probabilities(states, targets).astype(np.float64), minlength=len(out))
            waiting.clear()

    by_length = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    for i in range(0, len(documents), lanes):
        chosen = np.array(by_length[i : i + lanes])
        group = Lanes([documents[k] for k in chosen])
        chosen = chosen[group.order]
        h = np.zeros((len(chosen), network.hidden), network.vector.dtype)
        for tokens, _, active in group.windows():
            n = tokens.shape[1]
            before, _ = network.forward(tokens, active, h[:n])
            live = np.flatnonzero(np.arange(n)[None, :] < np.array(active)[:, None])
            waiting.append((before.reshape(-1, network.hidden)[live], tokens.ravel()[live], chosen[live % n]))
            size += len(live)
            if size >= PREDICTED_AT_ONCE:
                flush()
                size = 0
    flush()
    return out / np.log(10)


class Trainer:
    """Adam over windows of lanes. A window with fewer tokens than ``lanes`` full lanes moves the parameters less."""

    def __init__(self, network: Network, rate: float = 0.01, lanes: int = 128, clip: float = 1.0):
        self.network, self.rate, self.lanes, self.clip = network, rate, lanes, clip
        self.gradient, self.mean, self.square = (np.zeros_like(network.vector) for _ in range(3))
        self.updates, self.tokens = 0, 0
        parts = np.split(self.gradient, np.cumsum(network.sizes)[:-1])
        self.parts = {n: p.reshape(getattr(network, n).shape) for n, p in zip(network.NAMES, parts, strict=True)}

    def gradients(self, tokens: np.ndarray, first: np.ndarray, active: list[int], h: np.ndarray) -> np.ndarray:
        """The mean loss's gradient over one window; ``h`` is carried on."""
        net, H, part = self.network, self.network.hidden, self.parts
        before, (gates, c, u) = net.forward(tokens, active, h, first)
        width, kind = tokens.shape[1], net.vector.dtype
        before, gates, c, u = before[:, :width], gates[:, :width], c[:, :width], u[:, :width]
        live = np.flatnonzero(np.arange(width)[None, :] < np.array(active)[:, None])
        targets = tokens.ravel()[live]
        order, runs = net.by_class(targets)
        at, targets = live[order], targets[order]
        states = before.reshape(-1, H)[at]
        n, rows = len(targets), np.arange(len(targets))
        self.tokens += n
        ones = np.ones(n, kind)
        wrong = states @ net.to_class
        wrong += net.class_bias
        softmax(wrong, targets // net.slots)
        wrong[rows, targets // net.slots] -= 1
        np.matmul(states.T, wrong, out=part["to_class"])
        np.matmul(ones, wrong, out=part["class_bias"])
        back, slots = wrong @ net.to_class.T, targets % net.slots
        part["to_slot"][:] = 0
        part["slot_bias"][:] = 0
        for k, a, b in runs:
            own = states[a:b] @ net.to_slot[k]
            own += net.slot_bias[k]
            softmax(own, slots[a:b])
            own[rows[: b - a], slots[a:b]] -= 1
            np.matmul(states[a:b].T, own, out=part["to_slot"][k])
            np.matmul(ones[: b - a], own, out=part["slot_bias"][k])
            back[a:b] += own @ net.to_slot[k].T
        to_state = np.zeros((len(active), width, H), kind)
        to_state.reshape(-1, H)[at] = back
        # What a state's gradient becomes at each gate, for all steps at once.
        z, r = gates[:, :, :H], gates[:, :, H:]
        for_z, for_c, for_r = (before - c) * z * (1 - z), (1 - z) * (1 - c * c), u * r * (1 - r)
        at_state, flow = np.zeros((len(active), width, 3 * H), kind), np.zeros((len(active), width, 3 * H), kind)
        carried, from_state, goes_on = np.zeros((width, H), kind), net.state.T.copy(), ~first[:, :, None]
        for s in range(len(active) - 1, -1, -1):
            m = active[s]
            dh, to, out = carried[:m], at_state[s, :m], flow[s, :m]
            np.multiply(dh, for_z[s, :m], out=to[:, :H])
            np.multiply(dh, for_c[s, :m], out=out[:, 2 * H :])
            np.multiply(out[:, 2 * H :], for_r[s, :m], out=to[:, H : 2 * H])
            np.multiply(out[:, 2 * H :], r[s, :m], out=to[:, 2 * H :])
            dh *= z[s, :m]
            dh += to @ from_state
            dh += to_state[s, :m]
            # The state before a document's first token is fixed.
            dh *= goes_on[s, :m]
        flow[:, :, : 2 * H] = at_state[:, :, : 2 * H]
        np.matmul(before.reshape(-1, H).T, at_state.reshape(-1, 3 * H), out=part["state"])
        flow = flow.reshape(-1, 3 * H)[at]
        np.matmul(ones, flow, out=part["gate_bias"])
        part["inputs"][:] = 0
        starts = np.flatnonzero(np.concatenate([[True], targets[1:] != targets[:-1]]))
        part["inputs"][targets[starts]] = np.add.reduceat(flow, starts, axis=0)
        self.gradient *= 1 / n
        return self.gradient

    def step(self, gradient: np.ndarray, tokens: int) -> None:
        size = float(np.linalg.norm(gradient))
        if size > self.clip:
            gradient *= self.clip / size
        self.updates += 1
        self.mean *= 0.9
        self.mean += 0.1 * gradient
        self.square *= 0.99
        np.multiply(gradient, gradient, out=gradient)
        gradient *= 0.01
        self.square += gradient
        rate = self.rate * min(1.0, tokens / (self.lanes * WINDOW)) / (1 - 0.9**self.updates)
        np.multiply(self.square, 1 / (1 - 0.99**self.updates), out=gradient)
        np.sqrt(gradient, out=gradient)
        gradient += 1e-8
        np.divide(self.mean, gradient, out=gradient)
        gradient *= rate
        self.network.vector -= gradient

    def learn(self, documents: list[np.ndarray]) -> None:
        """One pass over documents, side by side in even streams."""
        group = Lanes(documents, self.lanes)
        h = np.zeros((len(group.lengths), self.network.hidden), self.network.vector.dtype)
        for tokens, first, active in group.windows():
            self.step(self.gradients(tokens, first, active, h), sum(active))
