"""A linear-chain conditional random field with two labels over the leaf blocks of a page.

A block's features are its ancestors' tags and attribute tokens, and what its text looks like. The model gives each
feature a weight for "main", and each pair of neighbouring labels one. It is trained on labelled pages by gradient
steps on the likelihood of whole label sequences, from forward and backward sums, and decoded by Viterbi.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from driftline.llm.blocks import Block, Element
from driftline.llm.labelled import KIND_OF, MAIN_TOKENS, NEUTRAL

ROUNDS, RATE, RIDGE = 200, 0.1, 0.004
#: Words that tell short blocks around an article from short blocks in it.
CUES = frozenset(
    "cookie cookies copyright subscribe newsletter comment comments share privacy login sign menu search related "
    "advertisement sponsored rights reserved terms reply follow".split()
)
STOPS = (".", "!", "?", "…", "。", "！", "？", ":", ";", '"', "”", "»")


#: Elements that are landmarks by themselves.
LANDMARKS = {"nav": "menu", "aside": "sidebar", "footer": "footer", "header": "header", "form": "form", "fieldset": "form", "article": "main", "main": "main"}


#: Words by which a name tells what an element has or lacks rather than what it is.
ABOUT = frozenset("with has have no not without non".split())


def landmark(tag: str, tokens: list[str]) -> str | None:
    """What part of a page an element starts, by its names or else its tag."""
    kinds = sorted(KIND_OF[t] for t in tokens if t in KIND_OF)
    if kinds:
        return kinds[0]
    if tag in LANDMARKS:
        return LANDMARKS[tag]
    return "main" if MAIN_TOKENS.intersection(tokens) else None


@lru_cache(maxsize=100_000)
def element_features(description: str) -> tuple[str, str | None, tuple[str, ...]]:
    """The tag of an element, the part of a page that it starts, and its features."""
    tag, *tokens = description.split(" ")
    tokens = [t for t in tokens if t not in NEUTRAL]
    if ABOUT.intersection(tokens):
        tokens = [t for t in tokens if t not in KIND_OF and t not in ABOUT]
    found = {f"in:{tag}", *(f"has:{t}" for t in tokens), *(f"kind:{KIND_OF[t]}" for t in tokens if t in KIND_OF)}
    return tag, landmark(tag, tokens), tuple(sorted(found))


def place_features(inner: str, around: str, outer: str, own: str, bare_h1: bool) -> tuple[str, ...]:
    """Features of a block's place: the parts that it lies in, and the elements right around it."""
    return "bias", f"near:{inner}", f"near:{inner}<{around}", f"near:{inner},h1:{bare_h1}", f"own:{own}", f"own:{outer}>{own}"


def path_features(path: tuple[str, ...]) -> tuple[str, ...]:
    found, inner, around = set(), "", ""
    for element in path:
        _, part, own = element_features(element)
        found.update(own)
        if part and part != inner:
            inner, around = part, inner
    outer, tag = (["", "", *(e.split(" ")[0] for e in path[-2:])])[-2:]
    return tuple(sorted(found.union(place_features(inner, around, outer, tag, path[-1:] == ("h1",)))))


def text_features(block: Block, first: bool, last: bool) -> list[str]:
    words = block.text.count(" ") + 1
    size = "1" if words < 2 else "4" if words < 5 else "12" if words < 13 else "30" if words < 31 else "more"
    share = block.linked / len(block.text)
    link = "none" if share == 0 else "few" if share < 0.3 else "some" if share < 0.7 else "all"
    found = [f"size:{size}", f"link:{link}", f"size:{size},link:{link}", "stop" if block.text.endswith(STOPS) else "open"]
    if "," in block.text:
        found.append("comma")
    if "©" in block.text:
        found.append("sign:c")
    if words < 31:
        found += [f"cue:{w}" for w in CUES.intersection(block.text.lower().split())]
    if first:
        found.append("first")
    if last:
        found.append("last")
    return found


@dataclass
class Crf:
    """Weights for "main" of each feature, of each pair of labels (before, after), and of the first label."""

    weights: dict[str, float] = field(default_factory=dict)
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def _place(self, element: Element | None) -> float:
        """The weight of a block's path. What an element adds to those around it is found once for all blocks in it, and
        features that the model does not know are left out, so the cost of an element does not grow with its depth."""
        get, weights = self.weights.get, self.weights
        new, at = [], element
        while at is not None and (at.told is None or at.told[0] is not self):
            new.append(at)
            at = at.around
        told = at.told if at is not None else (self, frozenset(), 0.0, "", "", "", self._around("", "", "", "", False))
        for e in reversed(new):
            _, known, total, inner, around, outer, _ = told
            tag, part, own = element_features(e.description)
            more = [f for f in own if f in weights and f not in known]
            if more:
                known, total = known.union(more), total + sum(map(get, more))
            if part and part != inner:
                inner, around = part, inner
            here = self._around(inner, around, outer, tag, e.description == "h1")
            told = e.told = (self, known, total, inner, around, tag, total + here)
        return told[-1]

    def _around(self, *place: object) -> float:
        return sum(self.weights.get(f, 0.0) for f in place_features(*place))

    def scores(self, blocks: Sequence[Block]) -> list[float]:
        get, out = self.weights.get, []
        for i, block in enumerate(blocks):
            own = text_features(block, i == 0, i == len(blocks) - 1)
            out.append(self._place(block.inside) + sum([get(f, 0.0) for f in own]))
        return out

    def decode(self, blocks: Sequence[Block]) -> list[bool]:
        """The likeliest labels, by Viterbi."""
        if not blocks:
            return []
        (oo, om), (mo, mm) = self.pairs.tolist()
        scores = self.scores(blocks)
        out, main, back = 0.0, scores[0], []
        for s in scores[1:]:
            to_out, to_main = (out + oo, main + mo), (out + om, main + mm)
            back.append((to_out[1] > to_out[0], to_main[1] > to_main[0]))
            out, main = max(to_out), max(to_main) + s
        labels = [main > out]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def sums(s: np.ndarray, there: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pages with block scores ``s`` (pages, blocks): the logarithm of the sum over all labellings, the probability of
    "main" of each block, and the expected number of each pair of labels, by forward and backward sums."""
    longest, both = s.shape[1], there[:, 1:]
    unary = np.stack([np.zeros_like(s), s], axis=2)
    forward, backward = np.zeros_like(unary), np.zeros_like(unary)
    forward[:, 0] = unary[:, 0]
    for t in range(1, longest):
        forward[:, t] = np.logaddexp.reduce(forward[:, t - 1, :, None] + pairs, axis=1) + unary[:, t]
        forward[:, t] = np.where(there[:, t, None], forward[:, t], forward[:, t - 1])
    for t in range(longest - 2, -1, -1):
        message = np.logaddexp.reduce(pairs + (unary[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
        backward[:, t] = np.where(there[:, t + 1, None], message, 0.0)
    total = np.logaddexp.reduce(forward[:, -1], axis=1)
    main = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])
    joint = forward[:, :-1, :, None] + pairs + (unary + backward)[:, 1:, None, :] - total[:, None, None, None]
    expected = np.where(both[:, :, None, None], np.exp(np.minimum(joint, 0)), 0).sum(axis=(0, 1))
    return total, main, expected


def train(pages: Sequence[tuple[Sequence[Block], Sequence[bool]]]) -> Crf:
    """A model from pages of blocks with their labels."""
    pages = [p for p in pages if p[0]]
    number: dict[str, int] = {}
    block_of, feature_of = [], []
    longest = max(len(blocks) for blocks, _ in pages)
    label = np.zeros((len(pages), longest))
    there = np.zeros((len(pages), longest), bool)
    for p, (blocks, labels) in enumerate(pages):
        there[p, : len(blocks)] = True
        label[p, : len(blocks)] = labels
        for i, block in enumerate(blocks):
            for f in (*path_features(block.path), *text_features(block, i == 0, i == len(blocks) - 1)):
                block_of.append(p * longest + i)
                feature_of.append(number.setdefault(f, len(number)))
    block_of, feature_of = np.array(block_of), np.array(feature_of)
    w, pairs = np.zeros(len(number)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(pairs), np.zeros_like(pairs)]
    both = there[:, 1:]
    seen = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            seen[a, b] = ((label[:, :-1] == a) & (label[:, 1:] == b) & both).sum()
    for step in range(1, ROUNDS + 1):
        s = np.bincount(block_of, w[feature_of], label.size).reshape(label.shape)
        _, main, expected = sums(s, there, pairs)
        miss = np.where(there, label - main, 0).ravel()
        gradients = (np.bincount(feature_of, miss[block_of], len(w)) - RIDGE * len(pages) / 100 * w, seen - expected - RIDGE * pairs)
        for k, (value, g) in enumerate(zip((w, pairs), gradients, strict=True)):
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * g
            moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * g * g
            value += RATE * (moments[2 * k] / (1 - 0.9**step)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    return Crf({f: float(w[i]) for f, i in number.items()}, pairs)
