"""The residual network: a wide stem, bottlenecks of which some halve the length, and a head of two layers, as numpy.

It has the interface of ``scoring.forward``, so ``scoring.score(rows, weights, network=residual.forward)`` runs it.
"""

from __future__ import annotations

import numpy as np

from ..functions.ranks import RANKS
from .scoring import CHANNELS, conv1d, masked_average

# Kernel of the stem; channels in and out, dilation and stride of the six bottlenecks; width of the head.
STEM, HEAD = 7, 256
BOTTLENECKS = ((64, 64, 1, 1), (64, 64, 2, 1), (64, 128, 1, 2), (128, 128, 2, 1), (128, 256, 1, 2), (256, 256, 2, 1))


def random_weights(seed: int = 0) -> dict[str, np.ndarray]:
    """Seeded weights of the right shapes; scales and shifts are those of batch norms, folded."""
    draw = np.random.default_rng(seed)
    out: dict[str, np.ndarray] = {}

    def layer(name: str, *shape: int, norm: bool = True) -> None:
        out[name] = (draw.standard_normal(shape) / np.sqrt(np.prod(shape[1:]))).astype(np.float32)
        if norm:
            out[f"{name}.scale"], out[f"{name}.shift"] = np.ones(shape[0], np.float32), np.zeros(shape[0], np.float32)

    layer("stem", BOTTLENECKS[0][0], CHANNELS, STEM)
    for k, (a, b, _, stride) in enumerate(BOTTLENECKS):
        middle = max(32, b // 4)
        if a != b or stride != 1:
            layer(f"block{k}.skip", b, a, 1, norm=False)
        layer(f"block{k}.reduce", middle, a, 1)
        layer(f"block{k}.conv", middle, middle, 3)
        layer(f"block{k}.expand", b, middle, 1)
    for k, (a, b) in enumerate(((BOTTLENECKS[-1][1] + 1, HEAD), (HEAD, len(RANKS)))):
        layer(f"head{k}.weight", b, a, norm=False)
        out[f"head{k}.bias"] = np.zeros(b, np.float32)
    return out


def erf(x: np.ndarray) -> np.ndarray:
    """The error function to 1.5e-7; the coefficients (Abramowitz and Stegun, 7.1.26) are fixed values."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - tail * np.exp(-x * x))


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + erf(x / np.sqrt(np.float32(2))))


def forward(x: np.ndarray, mask: np.ndarray, extra: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    """Logits [n, 7] of a batch [n, 22, t] with its mask [n, 1, t] and log-lengths [n].

    Whatever a layer puts into padding is cut off again, and the mask is halved with the length, so a row's logits are
    those it has alone.
    """

    def layer(name: str, v: np.ndarray, dilation: int = 1) -> np.ndarray:
        out = conv1d(v, weights[name], dilation)
        return out * weights[f"{name}.scale"][:, None] + weights[f"{name}.shift"][:, None]

    x = gelu(layer("stem", x)) * mask
    for k, (_, _, dilation, stride) in enumerate(BOTTLENECKS):
        x, mask = x[:, :, ::stride], mask[:, :, ::stride]
        skip = conv1d(x, weights[f"block{k}.skip"]) if f"block{k}.skip" in weights else x
        h = gelu(layer(f"block{k}.reduce", x)) * mask
        h = gelu(layer(f"block{k}.conv", h, dilation)) * mask
        x = gelu(layer(f"block{k}.expand", h) + skip) * mask
    h = np.concatenate([masked_average(x, mask), extra[:, None]], axis=1)
    h = gelu(h @ weights["head0.weight"].T + weights["head0.bias"])
    return h @ weights["head1.weight"].T + weights["head1.bias"]
