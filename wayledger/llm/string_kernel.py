"""A subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two sentences sums, over subsequences of three and four characters, the products of their weights, a
subsequence with a gap weighing DECAY for the character left out: words with a letter put in or taken out stay alike. It
is divided by the root of both sentences' numbers of places. As the subsequences are written out, as hashed features, a
machine that is a sum over landmarks is one weight vector: scoring needs no landmark any more and is exactly equal.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Hashed features.
BITS = 15
DECAY = 0.6
#: Offsets of the characters of a subsequence and its weight.
SHAPES = [((0, 1, 2), 1.0), ((0, 1, 3), DECAY), ((0, 2, 3), DECAY), ((0, 1, 2, 3), 1.0), ((0, 1, 2, 4), DECAY), ((0, 1, 3, 4), DECAY), ((0, 2, 3, 4), DECAY)]
#: Between two sentences stand so many characters of PAD that no subsequence has parts of both.
PAD = "\n" * 4

_MULT = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], dtype=np.uint32)


def features(codes: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """Per shape the feature at each place. codes ends in PAD."""
    n = len(codes) - len(PAD)
    c = codes.astype(np.uint32) + np.uint32(1)
    out = []
    for k, (offsets, weight) in enumerate(SHAPES):
        h = np.full(n, (k + 1) * 0x1000193 % 2**32 if k in (0, 3) else (1 if len(offsets) == 3 else 4) * 0x1000193, dtype=np.uint32)
        for o, m in zip(offsets, _MULT):
            h ^= c[o : o + n] * m
            h = (h << np.uint32(13)) | (h >> np.uint32(19))
        h *= np.uint32(0x5BD1E995)
        out.append(((h >> np.uint32(32 - BITS)).astype(np.int32), weight))
    return out


def joined(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all sentences, first place of each)."""
    text = PAD.join(sentences) + PAD
    sizes = np.fromiter((len(s) + len(PAD) for s in sentences), dtype=np.int64, count=len(sentences))
    return np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8), np.r_[0, np.cumsum(sizes)[:-1]]


def kernel_with(sentences: list[str], against: np.ndarray) -> np.ndarray:
    """<phi(sentence), column> over the root of the sentence's places, for each column of against (features x columns)."""
    out = np.zeros((len(sentences), against.shape[1]), dtype=np.float32)
    for i, s in enumerate(sentences):
        for idx, weight in features(np.frombuffer((s + PAD).encode("ascii", "replace"), dtype=np.uint8)):
            out[i] += weight * against[idx].sum(axis=0)
        out[i] /= np.sqrt(max(1, len(s)))
    return out


def explicit(sentence: str) -> np.ndarray:
    """phi of a sentence over the root of its places."""
    out = np.zeros(1 << BITS, dtype=np.float32)
    for idx, weight in features(np.frombuffer((sentence + PAD).encode("ascii", "replace"), dtype=np.uint8)):
        np.add.at(out, idx, np.float32(weight))
    return out / np.float32(np.sqrt(max(1, len(sentence))))


def sketches(sentences: list[str], dims: int = 512) -> np.ndarray:
    """Unit vectors whose products come close to the kernel's cosine, whatever the landmarks (a count sketch of phi)."""
    out = np.zeros((len(sentences), dims), dtype=np.float32)
    for row, s in zip(out, sentences):
        for idx, weight in features(np.frombuffer((s + PAD).encode("ascii", "replace"), dtype=np.uint8)):
            row += np.bincount(idx % dims, weights=np.where(idx // dims % 2, weight, -weight), minlength=dims).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


@dataclass
class Machine:
    weights: np.ndarray  # of the hashed features
    bias: float

    def scores(self, sentences: list[str]) -> np.ndarray:
        if not sentences:
            return np.zeros(0)
        codes, first = joined(sentences)
        at = np.zeros(len(codes), dtype=np.float32)
        n = len(codes) - len(PAD)
        for idx, weight in features(codes):
            at[:n] += np.float32(weight) * self.weights[idx]
        for k in range(len(PAD)):  # places of the pads are no part of any sentence
            at[np.r_[first[1:], len(codes)] - 1 - k] = 0
        size = np.fromiter((max(1, len(s)) for s in sentences), dtype=np.float64, count=len(sentences))
        return np.add.reduceat(at, first) / np.sqrt(size) + self.bias


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 20.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the examples inside the margin."""
    n, d = x.shape
    x1 = np.c_[x, np.ones(n, dtype=x.dtype)]
    w = np.zeros(d + 1)
    ridge = np.eye(d + 1)
    ridge[d, d] = 1e-3
    for _ in range(rounds):
        inside = np.nonzero(y * (x1 @ w.astype(x.dtype)) < 1)[0]
        square, side = ridge.copy(), np.zeros(d + 1)
        for lo in range(0, len(inside), 4096):  # in blocks, to keep double precision small
            own = inside[lo : lo + 4096]
            a = x1[own].astype(np.float64)
            square += 2 * c * (a.T * weight[own]) @ a
            side += 2 * c * a.T @ (weight[own] * y[own])
        new = np.linalg.solve(square, side)
        done = np.abs(new - w).max() < 1e-5
        w = new if done or not np.any(w) else 0.5 * w + 0.5 * new
        if done:
            break
    return w[:d], float(w[d])


def collapse(landmarks: np.ndarray, root: np.ndarray, w: np.ndarray, b: float) -> Machine:
    """The machine over Nystroem features K(x, landmarks) @ root as one weight vector of the hashed features."""
    return Machine((landmarks @ (root @ w)).astype(np.float32), b)


def nystroem(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features x landmarks, inverse root of the landmarks' kernel)."""
    landmarks = np.stack([explicit(s) for s in sentences], axis=1)
    values, vectors = np.linalg.eigh((landmarks.T @ landmarks).astype(np.float64))
    keep = values > 1e-4 * values.max()
    return landmarks, (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
