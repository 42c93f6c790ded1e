"""Linear-chain conditional random field over word ids, in numpy.

A word contributes three vectors of label scores: for itself, for its right neighbour and for its left neighbour.
They are sums of learned weights over the word's features, so a word is looked at once and cached; scoring a text is
then gathers and additions.  Features of the whole file add one more vector to all its words.  A chain is cut every
``SEGMENT`` words (neighbours and file features reach over the cut, transitions do not), so that sequences of like
length can be decoded side by side in bounded memory.
"""

import zlib

import numpy as np

CACHE_WORDS = 200_000    # distinct words a task remembers; beyond, the memory starts anew
SEGMENT = 256            # words of a chain
CELLS = 200_000          # words decoded side by side at most


class Model:
    """Weights of a trained field; small, so it travels with the tasks.

    ``weights[role, bucket, label]``: of a word's features for itself, and with neighbours also for the word after it,
    the word before it, and of file features for all words of the file.
    """

    def __init__(self, labels, weights, transitions, start):
        self.labels, self.weights, self.transitions, self.start = labels, weights, transitions, start


OWN, AFTER, BEFORE, FILE = range(4)


class Buckets(dict):
    """Feature name -> row of the weight table; names are remembered, as most recur."""

    def __init__(self, size):
        super().__init__()
        self.size = size

    def __missing__(self, name):
        if len(self) > CACHE_WORDS:
            self.clear()
        self[name] = at = zlib.crc32(name.encode("utf-8", "surrogatepass")) % self.size
        return at


class Lexicon(dict):
    """word -> row of the score tables, grown on demand."""

    def __init__(self, model, features):
        super().__init__()
        self.model, self.features = model, features
        roles, buckets, k = model.weights.shape
        self.buckets = Buckets(buckets)
        self.tables = np.zeros((0, min(roles, 3), k), np.float32)
        self.flat, self.counts = [], []      # features of words that are not in the tables yet

    def __missing__(self, word):
        ids = [self.buckets[n] for n in self.features(word)]
        self.flat += ids
        self.counts.append(len(ids))
        self[word] = at = len(self)
        return at

    def scored(self):
        """Score tables of all words seen."""
        if self.counts:
            edges = np.cumsum([0, *self.counts[:-1]])
            roles = self.tables.shape[1]
            new = [np.add.reduceat(self.model.weights[r][self.flat], edges, axis=0) for r in range(roles)]
            self.tables = np.concatenate([self.tables, np.stack(new, axis=1)])
            self.flat, self.counts = [], []
        return self.tables

    def renewed(self):
        """This lexicon, or an empty one when it has grown too large."""
        return self if len(self) < CACHE_WORDS else Lexicon(self.model, self.features)


def context_scores(lexicon, names):
    """Label scores that a file's features add to each of its words."""
    return lexicon.model.weights[FILE][[lexicon.buckets[n] for n in names]].sum(axis=0)


def segments(edges):
    """Cuts sequences into chains of at most ``SEGMENT`` words."""
    lengths = np.diff(edges)
    parts = -(-lengths // SEGMENT)
    firsts = np.repeat(edges[:-1], parts)
    within = np.arange(len(firsts)) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.concatenate((firsts + within * SEGMENT, edges[-1:]))


def emissions(tables, ids, edges):
    """Label scores per word; ``edges`` are the first words of the sequences and the number of words."""
    out = tables[ids, OWN]
    if tables.shape[1] > 1 and len(ids) > 1:
        inner = np.ones(len(ids), bool)
        inner[edges[:-1][edges[:-1] < len(ids)]] = False       # the first word of a sequence has no left neighbour
        after = np.flatnonzero(inner)
        out[after] += tables[ids[after - 1], AFTER]
        out[after - 1] += tables[ids[after], BEFORE]
    return out


def blocks(edges):
    """Groups of sequences of like length: (first words, lengths)."""
    lengths = np.diff(edges)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        longest = lengths[order[at]]
        stop = at + max(1, CELLS // int(longest))
        # a block mixes lengths down to a half only
        stop = min(stop, at + int(np.searchsorted(-lengths[order[at:]], -(longest // 2), side="right")))
        take = order[at:max(stop, at + 1)]
        yield edges[:-1][take], lengths[take]
        at += len(take)


def _padded(scores, firsts, lengths):
    """(longest, sequences, labels) scores and the mask of real words."""
    steps = np.arange(lengths.max())
    at = firsts[None, :] + np.minimum(steps[:, None], lengths[None, :] - 1)
    return scores[at], steps[:, None] < lengths[None, :], at


def viterbi(model, scores, edges):
    """Best label per word."""
    out = np.zeros(len(scores), np.int8)
    for firsts, lengths in blocks(edges):
        e, real, at = _padded(scores, firsts, lengths)
        steps, n, k = e.shape
        back = np.zeros((steps, n, k), np.int8)
        best = model.start + e[0]
        for t in range(1, steps):
            paths = best[:, :, None] + model.transitions[None]
            back[t] = paths.argmax(axis=1)
            best = np.where(real[t][:, None], paths.max(axis=1) + e[t], best)
        now = best.argmax(axis=1)
        rows = np.arange(n)
        for t in range(steps - 1, -1, -1):
            out[at[t][real[t]]] = now[real[t]]
            if t:
                now = np.where(real[t], back[t][rows, now], now)
    return out


def forward_backward(model, scores, edges, pairs=False):
    """Marginal probability of every label at every word; with ``pairs`` also the summed transition marginals."""
    out = np.zeros((len(scores), scores.shape[1]), np.float32)
    total, start = np.zeros_like(model.transitions, dtype=np.float64), np.zeros(scores.shape[1])
    step = np.exp(model.transitions.astype(np.float64))
    for firsts, lengths in blocks(edges):
        e, real, at = _padded(scores, firsts, lengths)
        steps, n, k = e.shape
        top = e.max(axis=2)
        p = np.exp((e - top[:, :, None]).astype(np.float64))
        alpha, scale = np.empty((steps, n, k)), np.ones((steps, n))
        a = np.exp(model.start) * p[0]
        scale[0] = a.sum(axis=1)
        alpha[0] = a / scale[0][:, None]
        for t in range(1, steps):
            a = (alpha[t - 1] @ step) * p[t]
            s = a.sum(axis=1)
            a /= s[:, None]
            alpha[t] = np.where(real[t][:, None], a, alpha[t - 1])
            scale[t] = np.where(real[t], s, 1.0)
        beta = np.ones((n, k))
        for t in range(steps - 1, -1, -1):
            g = alpha[t] * beta
            g /= g.sum(axis=1, keepdims=True)
            out[at[t][real[t]]] = g[real[t]]
            if t:
                here = p[t] * beta / scale[t][:, None]
                if pairs:
                    here_real = np.where(real[t][:, None], here, 0.0)
                    total += step * (alpha[t - 1].T @ here_real)
                beta = np.where(real[t][:, None], here @ step.T, beta)
        if pairs:
            start += out[firsts].sum(axis=0)
    return (out, total, start) if pairs else out


def train(sequences, labels, features, neighbours=True, buckets=1 << 15, rounds=30, rate=0.3, decay=1e-3):
    """Maximum-likelihood weights by AdaGrad over the whole training set.

    ``sequences``: list of (words, label numbers, names of file features).  The likelihood is convex; features share
    a table of ``buckets`` rows.
    """
    k, roles = len(labels), 3 if neighbours else 1
    vocab, flat, gold, edges, contexts, row = {}, [], [], [0], [], Buckets(buckets)
    for words, tags, names in sequences:
        if words:
            contexts.append(np.array([row[n] for n in names], np.int64))
            flat.extend(vocab.setdefault(w, len(vocab)) for w in words)
            gold.extend(tags)
            edges.append(len(flat))
    ids, gold, edges = np.array(flat, np.int64), np.array(gold, np.int64), np.array(edges, np.int64)
    held = [np.array([row[n] for n in features(w)], np.int64) for w in vocab]
    counts = np.array([len(x) for x in held], np.int64)
    joined = np.concatenate(held) if held else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(held)), counts)
    model = Model(labels, np.zeros((4 if neighbours else 1, buckets, k), np.float32), np.zeros((k, k)), np.zeros(k))
    if not len(ids):
        return model
    seen = [np.zeros(model.weights.shape), np.zeros((k, k)), np.zeros(k)]
    inner = np.ones(len(ids), bool)
    inner[edges[:-1]] = False
    after = np.flatnonzero(inner)
    # observed counts do not change
    target = np.zeros((len(ids), k))
    target[np.arange(len(ids)), gold] = 1
    gold_steps = np.zeros((k, k))
    np.add.at(gold_steps, (gold[after - 1], gold[after]), 1)
    gold_start = target[edges[:-1]].sum(axis=0)
    for _ in range(rounds):
        tables = np.empty((len(held), roles, k), np.float32)
        for r in range(roles):
            for c in range(k):
                tables[:, r, c] = np.bincount(owner, model.weights[r, joined, c], len(held))
        scores = emissions(tables, ids, edges)
        if neighbours:
            added = np.array([model.weights[FILE, c].sum(axis=0) for c in contexts])
            scores += np.repeat(added, np.diff(edges), axis=0)
        marginal, steps, start = forward_backward(model, scores, edges, pairs=True)
        wrong = (target - marginal) / len(ids)
        grad = np.zeros(model.weights.shape)
        for c in range(k):
            by_word = [np.bincount(ids, wrong[:, c], len(held))]
            if neighbours:
                by_word += [np.bincount(ids[after - 1], wrong[after, c], len(held)),
                            np.bincount(ids[after], wrong[after - 1, c], len(held))]
            for r in range(roles):
                grad[r, :, c] = np.bincount(joined, by_word[r][owner], buckets)
        if neighbours:
            for c, g in zip(contexts, np.add.reduceat(wrong, edges[:-1], axis=0)):
                np.add.at(grad[FILE], c, g)
        grads = [grad - decay * model.weights / buckets, (gold_steps - steps) / len(ids), (gold_start - start) / len(ids)]
        for value, g, s in zip((model.weights, model.transitions, model.start), grads, seen):
            s += g * g
            value += (rate * g / (np.sqrt(s) + 1e-9)).astype(value.dtype)
    return model
