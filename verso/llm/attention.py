"""One layer of causal self-attention over subword ids, trained and evaluated in numpy.

Input: frequent ids have a vector of their own, others one for each cell. Output: a probability of every id. The
first choice is among ``CELLS`` cells (the most frequent ids stand alone, the rest is dealt by surroundings in
words, place in the word and frequency); inside a cell a Huffman tree leads to the id, each node being a choice
between two branches. Both depend on the hidden state, so that the whole distribution is the attention's: cell
scores on the state and on the id just read, node scores on the state and on the node's counts. The state is a
soft sign, which costs less than a hyperbolic tangent.
"""

from __future__ import annotations

import math

import numpy as np

SINGLE, KINDS = 16, 5
CELLS = SINGLE + 4 * (KINDS + 1)
#: Ids with input vectors of their own; tree nodes (the most frequent ones) that see the hidden state; surroundings.
OWN, NODES, FREQUENT = 1024, 2048, 64
BLOCK, WIDTH = 8, 16
#: Row of the input table for places before a text.
PAD = OWN + CELLS
#: Windows in a step of training, and evaluated at a time: few enough for the processor's cache.
BATCH, AT_ONCE = 128, 128


def groups_of(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from vectors that are far from each other."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    centres = unit[:1]
    for _ in range(1, k):
        centres = np.concatenate([centres, unit[[(unit @ centres.T).max(axis=1).argmin()]]])
    for _ in range(rounds):
        at = (unit @ centres.T).argmax(axis=1)
        centres = np.stack([unit[at == j].sum(axis=0) if (at == j).any() else centres[j] for j in range(k)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return (unit @ centres.T).argmax(axis=1)


def frequent(counts: np.ndarray) -> np.ndarray:
    """Of each id its place among the ``FREQUENT`` most frequent ones, or -1."""
    place = np.full(len(counts), -1)
    place[np.argsort(-counts, kind="stable")[:FREQUENT]] = np.arange(min(FREQUENT, len(counts)))
    return place


class Codes:
    """Cells of ids, rows of the input table, and the paths through the cells' trees as flat arrays.

    ``counts``: of every id in the training words. ``initial``: whether an id starts a word. ``beside``: how often each
    id is in a word with each of the ``FREQUENT`` ids.
    """

    def __init__(self, counts: np.ndarray, initial: np.ndarray, beside: np.ndarray) -> None:
        n = len(counts)
        order = np.argsort(-counts, kind="stable")
        single, rest = order[:SINGLE], order[SINGLE:]
        kind = np.full(n, KINDS)
        met = rest[beside[rest].sum(axis=1) > 0]
        if len(met) > KINDS:
            weight = np.log1p(beside.sum() / (1 + beside.sum(axis=0))).astype(np.float32)
            kind[met] = groups_of(np.sqrt(beside[met]) * weight, KINDS)
        self.cell = np.empty(n, np.int64)
        self.cell[single] = np.arange(len(single))
        at = SINGLE
        for k in range(KINDS + 1):
            for starts in (False, True):
                # Each group in two halves by frequency.
                members = rest[(kind[rest] == k) & (initial[rest] == starts)]
                half = np.searchsorted(np.cumsum(counts[members] + 1.0), (counts[members] + 1.0).sum() / 2)
                self.cell[members[: half + 1]], self.cell[members[half + 1 :]] = at, at + 1
                at += 2
        self.row = np.append(OWN + self.cell, PAD)
        self.row[order[:OWN]] = np.arange(min(OWN, n))
        self._plant(counts + 0.1)

    def _plant(self, weights: np.ndarray) -> None:
        """Huffman trees of all cells. A node's bias is the log-odds of its branches; nodes are numbered by weight."""
        n = len(weights)
        paths: list[tuple] = [()] * n
        signs: list[tuple] = [()] * n
        mass: list[float] = []
        odds: list[float] = []
        by_cell = np.argsort(self.cell, kind="stable")
        edges = np.searchsorted(self.cell[by_cell], np.arange(CELLS + 1))
        for c in range(CELLS):
            members = by_cell[edges[c] : edges[c + 1]]
            if len(members) < 2:
                continue
            leaves = members[np.argsort(weights[members], kind="stable")]
            size, base = len(leaves), len(mass)
            value = weights[leaves].tolist()
            children: list[list[int]] = []
            # Leaves and joined nodes both come in order of weight.
            leaf, joined = 0, size
            for k in range(size, 2 * size - 1):
                pair = []
                for _ in range(2):
                    if leaf < size and (joined >= k or value[leaf] <= value[joined]):
                        pair.append(leaf)
                        leaf += 1
                    else:
                        pair.append(joined)
                        joined += 1
                children.append(pair)
                value.append(value[pair[0]] + value[pair[1]])
                mass.append(value[-1])
                odds.append(math.log(value[pair[1]] / value[pair[0]]))
            stack: list[tuple[int, tuple, tuple]] = [(2 * size - 2, (), ())]
            while stack:
                k, path, sign = stack.pop()
                if k < size:
                    paths[leaves[k]], signs[leaves[k]] = path, sign
                else:
                    path = (*path, base + k - size)
                    stack += [(children[k - size][0], path, (*sign, -1.0)), (children[k - size][1], path, (*sign, 1.0))]
        sizes = np.array([len(p) for p in paths])
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        number = np.empty(len(mass), np.int64)
        number[np.argsort(-np.array(mass), kind="stable")] = np.arange(len(mass))
        total = int(sizes.sum())
        self.node = number[np.fromiter((x for p in paths for x in p), np.int64, total)] if total else np.zeros(0, np.int64)
        self.sign = np.fromiter((x for p in signs for x in p), np.float32, total)
        self.bias = np.zeros(len(mass), np.float32)
        self.bias[number] = np.array(odds, np.float32)
        # Nodes that do not see the hidden state give each id a fixed log-probability.
        owner, seen = np.repeat(np.arange(n), sizes), self.node < NODES
        fixed = -np.logaddexp(0, -self.sign * self.bias[self.node] if total else np.zeros(0))
        self.rest = np.bincount(owner[~seen], weights=fixed[~seen], minlength=n).astype(np.float32)
        # Sizes as numbers of 16 bits, which are sorted by radix; with their signs turned, they stay in range.
        self.seen_size = np.bincount(owner[seen], minlength=n).astype(np.int16)
        self.seen_start = np.concatenate([[0], np.cumsum(self.seen_size, dtype=np.int64)])
        self.seen_node, self.seen_sign = self.node[seen], self.sign[seen]

    def paths(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all nodes on the ids' paths that see the hidden state: the id's place in ``ids``, the node and the branch taken (-1 or 1)."""
        start = self.seen_start.take(ids)
        sizes = self.seen_start.take(ids + 1) - start
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - sizes), sizes)
        return np.repeat(np.arange(len(ids)), sizes), self.seen_node.take(at), self.seen_sign.take(at)

    def levels(self, ids: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
        """All nodes on the ids' paths that see the hidden state, by their place on the path.

        The order of the ids in which the longest paths come first, how many of them have a first, a second, ... node,
        and all first, second, ... nodes of these with the branches taken (-1 or 1).
        """
        sizes = self.seen_size.take(ids)
        order = np.argsort(-sizes, kind="stable")
        counts = (len(ids) - np.cumsum(np.bincount(sizes, minlength=1)))[:-1].tolist()
        start = self.seen_start.take(ids.take(order))
        at = np.concatenate([start[:c] + k for k, c in enumerate(counts)]) if counts else start[:0]
        return order, counts, self.seen_node.take(at), self.seen_sign.take(at)


def _sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values (places x width) by row."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(rows):
        # Numbers of 16 bits are sorted by radix.
        order = np.argsort(rows.astype(np.uint16) if n <= 1 << 16 else rows, kind="stable")
        rows = rows.take(order)
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        # Two numbers are summed at a time, as the parts of one complex number.
        pairs = values.take(order, axis=0).view(np.result_type(values.dtype, np.complex64))
        out[rows.take(first)] = np.add.reduceat(pairs, first, axis=0).view(values.dtype)
    return out


class Attention:
    """The model's weights (float32) and what is computed from them.

    ``pairs``: counts of (input row, cell that follows), from all training words.
    """

    NAMES = ("embed", "query", "key", "value", "place", "mix", "out", "nodes")

    def __init__(self, codes: Codes, pairs: np.ndarray, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.codes = codes
        self.embed, self.query, self.key, self.value = draw(PAD + 1, WIDTH), draw(WIDTH, WIDTH), draw(WIDTH, WIDTH), draw(WIDTH, WIDTH)
        self.place, self.mix, self.out = np.zeros(2 * BLOCK, np.float32), draw(WIDTH, WIDTH), np.zeros((WIDTH, CELLS), np.float32)
        self.nodes = np.zeros((NODES, WIDTH), np.float32)
        prior = (pairs.sum(axis=0) + 0.1) / (pairs.sum() + 0.1 * CELLS)
        self.follow = np.log((pairs + 20 * prior) / (pairs.sum(axis=1, keepdims=True) + 20)).astype(np.float32)
        # A cell without ids is never chosen.
        self.follow[:, np.bincount(codes.cell, minlength=CELLS) == 0] = -80
        distance = (np.arange(BLOCK)[:, None] + BLOCK) - np.arange(2 * BLOCK)[None, :]
        self.past, self.distance = distance >= 0, np.maximum(distance, 0)

    def step(self, rows: np.ndarray, ids: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the ids that are real, and its gradients."""
        kind, many = self.embed.dtype, len(rows)
        last, ids, real = np.ascontiguousarray(rows[:, BLOCK:]).ravel(), ids.ravel(), real.ravel()
        kept = np.flatnonzero(real)
        n, at = max(1, len(kept)), np.arange(len(ids))
        # What windows attend to (keys, values) and what asks (queries, own parts) are products of their own input
        # vectors, so that gradients are summed by input row once, at the width of a vector.
        tells, asks = np.concatenate([self.key, self.value], axis=1), np.concatenate([self.query / kind.type(math.sqrt(WIDTH)), self.mix], axis=1)
        read = self.embed.take(rows.ravel(), axis=0)
        asking = np.ascontiguousarray(read.reshape(many, 2 * BLOCK, WIDTH)[:, BLOCK:]).reshape(-1, WIDTH)
        told, asked = (read @ tells).reshape(many, 2 * BLOCK, -1), (asking @ asks).reshape(many, BLOCK, -1)
        key, value, query, own = told[:, :, :WIDTH], told[:, :, WIDTH:], asked[:, :, :WIDTH], asked[:, :, WIDTH:]

        scores = np.matmul(query, key.transpose(0, 2, 1))
        if max(scores.max() + self.place.max(), -scores.min() - self.place.min()) > 40:  # else no sum is too large or too small
            scores += np.where(self.past, self.place[self.distance], -1e9).astype(kind)
            scores += np.where(rows == PAD, -1e4, 0).astype(kind)[:, None, :]
            scores -= scores.max(axis=2, keepdims=True)
            np.exp(scores, out=scores)
        else:
            np.exp(scores, out=scores)
            scores *= np.where(self.past, np.exp(self.place[self.distance]), 0).astype(kind)
            scores *= (rows != PAD).astype(kind)[:, None, :]
        scores *= (1 / (scores.reshape(-1, 2 * BLOCK) @ np.ones(2 * BLOCK, kind) + kind.type(1e-30))).reshape(many, BLOCK, 1)
        seen = np.matmul(scores, value)
        states = own + seen
        slope = np.abs(states)
        slope += 1
        np.divide(1, slope, out=slope)
        states *= slope
        hidden = states.reshape(-1, WIDTH)

        cells = self.codes.cell.take(ids)
        d = hidden @ self.out
        d += self.follow.take(last, axis=0)
        if np.abs(self.out).sum(axis=0).max() > 60:  # else no sum is too large or too small, since each row of follow has a cell of 1 / CELLS or more
            d -= d.max(axis=1, keepdims=True)
        loss = -float(d[at, cells].take(kept).sum(dtype=np.float64))
        np.exp(d, out=d)
        total = d @ np.ones(CELLS, kind)
        loss += float(np.log(total.take(kept)).sum(dtype=np.float64))
        weight = real.astype(kind) / kind.type(n)
        d *= (weight / total)[:, None]
        d[at, cells] -= weight
        g = {"out": hidden.T @ d}
        dh = d @ self.out.T

        order, counts, node, sign = self.codes.levels(ids.take(kept))
        loss -= float(self.codes.rest.take(ids.take(kept)).sum(dtype=np.float64))
        if counts:
            kept = kept.take(order[: counts[0]])
            on = hidden.take(kept, axis=0)
            on, turned = np.concatenate([on[:c] for c in counts]), self.nodes.take(node, axis=0)
            z = np.einsum("ij,ij->i", on, turned)
            z += self.codes.bias.take(node)
            z *= sign
            np.exp(np.minimum(np.negative(z, out=z), 60, out=z), out=z)
            loss += float(np.log1p(z).sum(dtype=np.float64))
            z /= (1 + z) * -n
            z *= sign
            turned *= z[:, None]
            on *= z[:, None]
            first = counts[0]
            sums, begin = turned[:first], first
            for c in counts[1:]:
                sums[:c] += turned[begin : begin + c]
                begin += c
            dh[kept] += sums
            g["nodes"] = _sums(node, on, len(self.nodes))
        else:
            g["nodes"] = np.zeros_like(self.nodes)

        slope *= slope
        dh = dh.reshape(states.shape)
        dh *= slope
        ds = np.matmul(dh, value.transpose(0, 2, 1))
        ds -= np.einsum("ijk,ijk->ij", dh, seen)[:, :, None]
        ds *= scores
        dtold, dasked = np.empty_like(told), np.empty_like(asked)
        np.matmul(ds, key, out=dasked[:, :, :WIDTH])
        dasked[:, :, WIDTH:] = dh
        np.matmul(ds.transpose(0, 2, 1), query, out=dtold[:, :, :WIDTH])
        np.matmul(scores.transpose(0, 2, 1), dh, out=dtold[:, :, WIDTH:])
        dtold, dasked = dtold.reshape(-1, 2 * WIDTH), dasked.reshape(-1, 2 * WIDTH)
        g["key"], g["value"] = np.split(read.T @ dtold, 2, axis=1)
        g["query"], g["mix"] = np.split(asking.T @ dasked, 2, axis=1)
        g["query"] = g["query"] / kind.type(math.sqrt(WIDTH))
        dread = dtold @ tells.T
        dread.reshape(many, 2 * BLOCK, WIDTH)[:, BLOCK:] += (dasked @ asks.T).reshape(many, BLOCK, WIDTH)
        g["embed"] = _sums(rows.ravel(), dread, PAD + 1)
        g["place"] = np.bincount(self.distance[self.past], weights=ds.sum(axis=0)[self.past], minlength=2 * BLOCK)
        return loss / n, g

    def descend(self, batches, rate) -> list[float]:
        """A step of Adam for each batch of windows, ids and which are real; ``rate`` by the step's number."""
        flat = self.weights().astype(np.float32)
        self.put(flat, copy=False)
        g, old, square, change = np.empty_like(flat), np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
        losses = []
        for t, windows in enumerate(batches, 1):
            loss, found = self.step(*windows)
            losses.append(loss)
            np.concatenate([found[k].ravel() for k in self.NAMES], out=g, casting="same_kind")
            # Sums of what is remembered; their factors of 0.1 and 0.01 are in the step's size.
            old *= 0.9
            old += g
            square *= 0.99
            np.multiply(g, g, out=g)
            square += g
            size = math.sqrt(0.01 / (1 - 0.99**t))
            np.sqrt(square, out=change)
            change += 1e-8 / size
            np.divide(old, change, out=change)
            change *= rate(t) * 0.1 / (1 - 0.9**t) / size
            flat -= change
        return losses

    def weights(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES]).astype(np.float64)

    def put(self, weights: np.ndarray, copy: bool = True) -> None:
        """Take the weights, as copies or (if they are float32) where they are."""
        for k in self.NAMES:
            old = getattr(self, k)
            setattr(self, k, weights[: old.size].reshape(old.shape).astype(np.float32, copy=copy))
            weights = weights[old.size :]

    def tables(self) -> tuple[np.ndarray, ...]:
        """What scoring looks up: keys and values (with a 1 to count by) of all rows, queries and own parts, and distances."""
        told = np.concatenate([self.embed @ self.key, self.embed @ self.value, np.ones((PAD + 1, 1), np.float32)], axis=1)
        told[PAD, WIDTH:] = 0
        asked = np.concatenate([self.embed @ self.query / math.sqrt(WIDTH), self.embed @ self.mix], axis=1)
        place = np.where(self.past, np.exp(self.place[self.distance] - self.place.max()), 0).astype(np.float32)
        return told.astype(np.float32), asked.astype(np.float32), place

    def logs(self, windows: np.ndarray, targets: np.ndarray, tables: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
        """Log-probability of each target (ids, as the windows); the same numbers as :meth:`step` has, in fewer passes."""
        told, asked, place = tables or self.tables()
        out = np.empty(targets.size, np.float32)
        ones = np.ones(CELLS, np.float32)
        # Only weights that could overflow need their rows' maxima.
        wide = float(np.abs(self.out).sum(axis=0).max() + np.abs(self.follow).max()) > 85
        for k in range(0, len(windows), AT_ONCE):
            rows = self.codes.row.take(windows[k : k + AT_ONCE])
            ids = targets[k : k + AT_ONCE].ravel()
            last = rows[:, BLOCK:]
            right, left = told.take(rows, axis=0), asked.take(last, axis=0)
            scores = np.matmul(left[:, :, :WIDTH], right[:, :, :WIDTH].transpose(0, 2, 1))
            np.minimum(scores, 60, out=scores)
            np.exp(scores, out=scores)
            scores *= place
            seen = np.matmul(scores, right[:, :, WIDTH:])
            hidden = left[:, :, WIDTH:] + seen[:, :, :WIDTH] / (seen[:, :, WIDTH:] + np.float32(1e-30))
            hidden /= 1 + np.abs(hidden)
            hidden = hidden.reshape(-1, WIDTH)
            cells = hidden @ self.out
            cells += self.follow.take(last.ravel(), axis=0)
            if wide:
                cells -= cells.max(axis=1, keepdims=True)
            found = cells[np.arange(len(ids)), self.codes.cell.take(ids)]
            np.exp(cells, out=cells)
            found -= np.log(cells @ ones)
            of, node, sign = self.codes.paths(ids)
            z = np.einsum("ij,ij->i", hidden.take(of, axis=0), self.nodes.take(node, axis=0))
            z += self.codes.bias.take(node)
            z *= sign
            # The product of the branches' chances, as logs: -log(1 + exp(-z)).
            np.negative(z, out=z)
            np.exp(np.minimum(z, 60, out=z), out=z)
            found += self.codes.rest.take(ids)
            out[k * BLOCK : k * BLOCK + len(ids)] = found - np.bincount(of, weights=np.log1p(z), minlength=len(ids))
        return out


def blocks_of(texts: list[np.ndarray], end: int, starts: list[bool] | None = None, ends: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ids (a block and the one before it), ids to predict, which of them count, and each window's text.

    A text's inputs start with the end id (nothing has been read), its targets end with it, unless ``starts`` or
    ``ends`` says that it is a part without its text's start or end. The id after the end's stands before texts.
    """
    pad = end + 1
    starts, ends = starts or [True] * len(texts), ends or [True] * len(texts)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    windows = -(-sizes // BLOCK)
    first = np.cumsum(windows) - windows
    inputs = np.full(int(windows.sum()) * BLOCK + 1, pad, np.int64)
    targets = np.full(len(inputs) - 1, -1, np.int64)
    at = first * BLOCK
    flat = np.concatenate([*texts, np.zeros(0, np.int64)]).astype(np.int64)
    place = np.arange(len(flat)) + np.repeat(at - (np.cumsum(sizes - 1) - (sizes - 1)), sizes - 1)
    inputs[place + 1] = flat
    targets[place] = flat
    inputs[at] = np.where(starts, end, pad)
    # What comes first in a part has nothing before it that could predict it.
    targets[at] = np.where(starts, targets[at], -1)
    closed = np.array(ends, bool)
    targets[(at + sizes - 1)[closed]] = end
    inputs, targets = inputs[:-1].reshape(-1, BLOCK), targets.reshape(-1, BLOCK)
    before = np.full_like(inputs, pad)
    before[1:] = inputs[:-1]
    before[first] = pad
    return np.concatenate([before, inputs], axis=1), np.maximum(targets, 0), targets >= 0, np.repeat(np.arange(len(texts)), windows)
