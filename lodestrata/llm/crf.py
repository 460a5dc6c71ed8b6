"""A small linear-chain conditional random field, trained in numpy on a bounded set of sequences."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class ChainCrf:
    emit: np.ndarray  # features x labels
    step: np.ndarray  # labels x labels
    begin: np.ndarray  # labels
    end: np.ndarray  # labels

    @staticmethod
    def fit(sequences: list[np.ndarray], labels: list[np.ndarray], n_labels: int, rounds: int = 90, rate: float = 0.2, l2: float = 1e-3) -> ChainCrf:
        """Adam on the penalised log-likelihood; sequences are (length x features) arrays."""
        n, length, feats = len(sequences), max(map(len, sequences)), sequences[0].shape[1]
        x = np.zeros((n, length, feats))
        y = np.zeros((n, length), dtype=np.int64)
        size = np.array([len(s) for s in sequences])
        for i, (s, t) in enumerate(zip(sequences, labels, strict=True)):
            x[i, : len(s)], y[i, : len(s)] = s, t
        real = np.arange(length) < size[:, None]
        one = np.eye(n_labels)[y] * real[:, :, None]
        rows = np.arange(n)
        flat = np.ascontiguousarray(x.reshape(-1, feats).T)
        want_emit = flat @ one.reshape(-1, n_labels)
        want_step = np.einsum("nlj,nlk->jk", one[:, :-1], one[:, 1:])
        want_begin, want_end = one[:, 0].sum(0), one[rows, size - 1].sum(0)
        shapes = [(feats, n_labels), (n_labels, n_labels), (n_labels,), (n_labels,)]
        theta = [np.zeros(s) for s in shapes]
        m = [np.zeros(s) for s in shapes]
        v = [np.zeros(s) for s in shapes]
        for t in range(1, rounds + 1):
            emit, step, begin, end = theta
            score = x @ emit
            a = np.zeros((n, length, n_labels))
            b = np.zeros((n, length, n_labels))
            a[:, 0] = score[:, 0] + begin
            for i in range(1, length):
                nxt = _logsumexp(a[:, i - 1, :, None] + step, 1) + score[:, i]
                a[:, i] = np.where(real[:, i, None], nxt, a[:, i - 1])
            b[rows, size - 1] = end
            for i in range(length - 2, -1, -1):
                back = _logsumexp(step + (score[:, i + 1] + b[:, i + 1])[:, None, :], 2)
                b[:, i] = np.where((i < size - 1)[:, None], back, np.where((i == size - 1)[:, None], end, 0))
            z = _logsumexp(a[:, -1] + end, 1)
            p = np.exp(a + b - z[:, None, None]) * real[:, :, None]
            got_emit = flat @ p.reshape(-1, n_labels)
            got_step = np.zeros((n_labels, n_labels))
            for i in range(length - 1):
                on = real[:, i + 1]
                if on.any():
                    q = a[on, i, :, None] + step + (score[on, i + 1] + b[on, i + 1])[:, None, :] - z[on, None, None]
                    got_step += np.exp(q).sum(0)
            grads = [
                (want_emit - got_emit) / n - l2 * emit,
                (want_step - got_step) / n - l2 * step,
                (want_begin - p[:, 0].sum(0)) / n - l2 * begin,
                (want_end - p[rows, size - 1].sum(0)) / n - l2 * end,
            ]
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                theta[k] = theta[k] + rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return ChainCrf(*theta)

    def tag(self, x: np.ndarray) -> list[int]:
        """The best labels of one sequence."""
        score = x @ self.emit
        best = score[0] + self.begin
        back = []
        for s in score[1:]:
            c = best[:, None] + self.step
            back.append(c.argmax(0))
            best = c.max(0) + s
        out = [int((best + self.end).argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]
